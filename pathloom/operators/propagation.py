"""Guide lines and contours carried through recordings: sparse tracking both ways in batches, blended and refined in a field.

The field is the inverse gray value, or that of conformal forests fitted at every step on the pixels around the line of the step
before, with those of the steps before it in falling numbers (``Classifier``).

Frame n + 1 needs the line of frame n, so a layer is worked off in frame order; layers and recordings run in parallel. Rows are
dealt by layer and sorted by frame, and a task streams them: it holds one batch of frames and the layer's state, whatever the
recording's length.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import forests
from pathloom.operators.features import blur, correlate, region_features
from pathloom.operators.sequences import gauss
from pathloom.schemas import TIMELINE

LOG = logging.getLogger(__name__)
SHRINK, WINDOW, LEVELS, ROUNDS, STILL, RETURN = 4, 21, 2, 35, 0.01, 2.5
#: Longest side of an image that is moved to all places at once; how far others are.
TINY, SHIFTS = 8, 3
#: Partitions that layers are dealt to at least: far more than the layers that run side by side, so that two seldom wait for each other in one task.
DEALT = 256
#: How far a contour's points are moved in the field after tracking.
NUDGE = 3


def resample(points: np.ndarray, n: int, closed: bool = False) -> np.ndarray:
    """n points at equal arc lengths, as ``sequences.resample_open`` and ``resample_closed``."""
    if len(points) < (3 if closed else 2):
        return np.zeros((n, 2))
    p = np.concatenate([points, points[:1]]) if closed else points
    at = np.concatenate([[0], np.cumsum(np.sqrt((np.diff(p, axis=0) ** 2).sum(1)))])
    if at[-1] <= 0:
        return np.repeat(points[:1], n, 0)
    to = np.arange(n) * at[-1] / n if closed else np.linspace(0, at[-1], n)
    return np.stack([np.interp(to, at, p[:, k]) for k in (0, 1)], 1)


@dataclass(frozen=True)
class Level:
    """One image of a pyramid with its gradients, (3, height, width), each with its border repeated WINDOW + 1 pixels beyond it."""

    height: int
    width: int
    wide: np.ndarray

    @classmethod
    def of(cls, image: np.ndarray) -> "Level":
        d, s = np.array([-1.0, 0, 1]) / 2, np.ones(1)
        all_ = np.stack([image, correlate(correlate(image, s, 0), d, 1), correlate(correlate(image, d, 0), s, 1)])
        return cls(*image.shape, np.pad(all_, ((0, 0), (WINDOW + 1, WINDOW + 1), (WINDOW + 1, WINDOW + 1)), "edge"))

    @cached_property
    def corners(self) -> np.ndarray:
        """The three values at each place and at the next ones right, below, and right below: (4, 3 x pixels)."""
        o = WINDOW + 1
        return np.stack([self.wide[:, o + dy : o + dy + self.height, o + dx : o + dx + self.width].ravel() for dy in (0, 1) for dx in (0, 1)])

    @property
    def shifts(self) -> int:
        """How far ``shifted`` goes: a tiny image's whole side, from where on every place shows the border."""
        side = max(self.height, self.width)
        return side if side <= TINY else SHIFTS

    @cached_property
    def moved(self) -> np.ndarray:
        """The image as it is seen at each move along both axes; it is in its place at (WINDOW + 1, WINDOW + 1)."""
        return np.lib.stride_tricks.sliding_window_view(self.wide[0], (self.height, self.width))

    @cached_property
    def shifted(self) -> np.ndarray:
        """The image moved by -shifts to shifts + 1 places along both axes: (pixels, moves)."""
        own = slice(WINDOW + 1 - self.shifts, WINDOW + 3 + self.shifts)
        return np.ascontiguousarray(self.moved[own, own].reshape(-1, self.height * self.width).T)

    def windows(self, at: np.ndarray, r: int) -> np.ndarray:
        """The three values in the windows of +-r around places (points, xy), bilinear: (3, points, window, window)."""
        off = WINDOW // 2 + 1  # from there a window is all border, further off is the same
        at = np.clip(at, -off, np.array([self.width, self.height]) - 1 + off)
        c = np.floor(at).astype(int)
        t, u = (at - c).T[:, None, :, None, None]
        v = np.empty((3, len(at), 2 * r + 2, 2 * r + 2))
        for i, (x, y) in enumerate((c + WINDOW + 1 - r).tolist()):
            v[:, i] = self.wide[:, y : y + 2 * r + 2, x : x + 2 * r + 2]
        v = v[:, :, :-1] * (1 - u) + v[:, :, 1:] * u
        return v[..., :-1] * (1 - t) + v[..., 1:] * t


def pyramid(image: np.ndarray) -> list[Level]:
    """The image and halves of it, as far as they have 8 pixels a side to be halved."""
    out = [image]
    while len(out) <= LEVELS and min(out[-1].shape) >= 8:
        out.append(blur(out[-1], 1.0)[::2, ::2])
    return [Level.of(x) for x in out]


def _window_moves(a: Level, b: Level, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A level's rounds from the moves given, by windows around each place of ``a``; the new moves, and which places have texture."""
    n, off, right, low, move = len(at), WINDOW // 2 + 1, a.width - 1, a.height - 1, move.copy()
    r = int(min(WINDOW // 2, np.ceil(max(at.max(initial=0), (np.array([right, low]) - at).max(initial=0)))))  # as far as the image goes
    o = np.arange(-r, r + 1.0)
    x, y = at[:, :1] + o, at[:, 1:] + o
    there = ((y >= 0) & (y <= low))[:, :, None] & ((x >= 0) & (x <= right))[:, None]  # what a window holds beyond the image tells nothing
    ia, ix, iy = a.windows(at, r)
    g = np.stack([ix * there, iy * there], 1)
    xx, yy, xy = (g[:, 0] * g[:, 0]).sum((1, 2)), (g[:, 1] * g[:, 1]).sum((1, 2)), (g[:, 0] * g[:, 1]).sum((1, 2))
    det = xx * yy - xy * xy
    least = ((xx + yy) - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 / WINDOW**2
    solid = (least > 1e-4) & (det > 1e-9)
    own = (g * ia[:, None]).sum((2, 3))
    four = np.zeros((n, 2, 2, 2, 2 * r + 2, 2 * r + 2))  # the gradients laid over the window of each whole place
    for dy in (0, 1):
        for dx in (0, 1):
            four[:, :, dy, dx, dy : dy + 2 * r + 1, dx : dx + 2 * r + 1] = g
    four = four.reshape(n, 8, (2 * r + 2) ** 2)
    numbers = np.concatenate([at, move, own, xx[:, None], yy[:, None], xy[:, None], det[:, None]], 1).tolist()
    for i in np.flatnonzero(solid).tolist():
        px, py, mx, my, ox, oy, sxx, syy, sxy, d = numbers[i]
        cell, s = None, []
        for _ in range(ROUNDS):
            qx, qy = min(max(px + mx, -off), b.width - 1 + off), min(max(py + my, -off), b.height - 1 + off)
            cx, cy = floor(qx), floor(qy)
            if (cx, cy) != cell:
                cell, x0, y0 = (cx, cy), cx + WINDOW + 1 - r, cy + WINDOW + 1 - r
                s = (four[i] @ b.wide[0, y0 : y0 + 2 * r + 2, x0 : x0 + 2 * r + 2].ravel()).tolist()
            t, u = qx - cx, qy - cy
            ex = ox - ((s[0] * (1 - t) + s[1] * t) * (1 - u) + (s[2] * (1 - t) + s[3] * t) * u)
            ey = oy - ((s[4] * (1 - t) + s[5] * t) * (1 - u) + (s[6] * (1 - t) + s[7] * t) * u)
            dx, dy = (syy * ex - sxy * ey) / d, (sxx * ey - sxy * ex) / d
            mx, my = mx + dx, my + dy
            if abs(dx) < STILL and abs(dy) < STILL:
                break
        move[i] = mx, my
    return move, solid


def _whole_moves(a: Level, b: Level, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_window_moves`` on images of WINDOW pixels a side or less, whose own grid all windows lie on.

    The sums of all points with the other image moved by a few places are then one product of matrices; those of points that go further are taken when they
    are there. A step is a polynomial of the place between four whole ones. From a whole side on every move shows the border.
    """
    n, (w, h), s, side, o = len(at), (a.width, a.height), b.shifts, max(a.width, a.height), WINDOW + 1
    c = np.floor(at)
    t, u = part = (at - c).T
    ia, ix, iy = (np.stack([(1 - u) * (1 - t), (1 - u) * t, u * (1 - t), u * t], 1) @ a.corners).reshape(n, 3, -1).transpose(1, 0, 2)
    inx, iny = ((np.abs(np.arange(size) - c[:, k : k + 1]) <= WINDOW // 2) & (np.arange(size) + part[k][:, None] <= size - 1) for k, size in ((0, w), (1, h)))
    there = (iny[:, :, None] & inx[:, None]).reshape(n, -1)
    gx, gy = ix * there, iy * there
    xx, yy, xy = (np.einsum("ik,ik->i", p, q) for p, q in ((gx, gx), (gy, gy), (gx, gy)))
    det = xx * yy - xy * xy
    least = ((xx + yy) - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 / WINDOW**2
    solid = (least > 1e-4) & (det > 1e-9)
    d = np.where(solid, det, 1.0)
    g = np.empty((2, n, w * h))  # what a difference at a place adds to a step
    g[0], g[1] = (yy / d)[:, None] * gx - (xy / d)[:, None] * gy, (xx / d)[:, None] * gy - (xy / d)[:, None] * gx
    own = np.einsum("dik,ik->id", g, ia).tolist()
    sums = (g.reshape(2 * n, -1) @ b.shifted).reshape(2, n, 2 * s + 2, 2 * s + 2).transpose(1, 2, 3, 0)
    out, cells, numbers = move.tolist(), c.astype(int).tolist(), np.concatenate([at, move], 1).tolist()
    for i in np.flatnonzero(solid).tolist():
        (px, py, mx, my), (cx, cy), (ox, oy) = numbers[i], cells[i], own[i]
        left, known = ROUNDS, {}
        while left:
            t, u = px + mx, py + my
            fx, fy = floor(t), floor(u)
            kx, ky = fx - cx, fy - cy
            if not (-side <= kx <= side and -side <= ky <= side):
                kx, ky = min(max(kx, -side), side), min(max(ky, -side), side)
            step = known.get((kx, ky))
            if step is None:
                if -s <= kx <= s and -s <= ky <= s:
                    near = sums[i, ky + s : ky + s + 2, kx + s : kx + s + 2]
                else:
                    near = (b.moved[o + ky : o + ky + 2, o + kx : o + kx + 2].reshape(4, -1) @ g[:, i].T).reshape(2, 2, 2)
                ((p00, q00), (p01, q01)), ((p10, q10), (p11, q11)) = near.tolist()
                step = ox - p00, p00 - p01, p00 - p10, p01 + p10 - p00 - p11, oy - q00, q00 - q01, q00 - q10, q01 + q10 - q00 - q11
                known[kx, ky] = step
            a0, a1, a2, a3, b0, b1, b2, b3 = step
            t, u = t - fx, u - fy
            while True:
                tu = t * u
                dx, dy = a0 + a1 * t + a2 * u + a3 * tu, b0 + b1 * t + b2 * u + b3 * tu
                mx, my, t, u, left = mx + dx, my + dy, t + dx, u + dy, left - 1
                if -STILL < dx < STILL and -STILL < dy < STILL:
                    left = 0
                if not left or not (0 <= t < 1 and 0 <= u < 1):
                    break
        out[i] = mx, my
    return np.array(out, float).reshape(n, 2), solid


def sparse_flow(one: np.ndarray | list[Level], two: np.ndarray | list[Level], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Iterative least-squares tracking of points on a pyramid; the new places, and whether each is in the image with texture.

    Points that are not finite stay as they are and are not found. A window's sums with the gradients are linear in the four whole
    places around it, so they are taken for those, once, and a round is a mean of four numbers; on small images all points' at a time.
    """
    one, two = (p if isinstance(p, list) else pyramid(p) for p in (one, two))
    real = np.isfinite(points).all(1)
    given, points = points, np.where(real[:, None], points, 0.0)
    move, fine = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(min(len(one), len(two)) - 1, -1, -1):
        a, b = one[level], two[level]
        move, solid = (_whole_moves if a.wide.shape == b.wide.shape and max(a.height, a.width) <= WINDOW else _window_moves)(a, b, points / 2**level, move)
        fine &= solid
        if level:
            move = move * 2
    new, fine = np.where(real[:, None], points + move, given), fine & real
    h, w = one[0].height, one[0].width
    return new, fine & (new[:, 0] >= 0) & (new[:, 0] <= w - 1) & (new[:, 1] >= 0) & (new[:, 1] <= h - 1)


def _small(gray: np.ndarray) -> np.ndarray:
    """Inverted, blurred by 7 x 7, and averaged over blocks of SHRINK."""
    x = blur(255.0 - gray, 1.4, 3)
    h, w = max(1, x.shape[0] // SHRINK), max(1, x.shape[1] // SHRINK)
    if x.shape[0] < SHRINK or x.shape[1] < SHRINK:
        return x
    return x[: h * SHRINK, : w * SHRINK].reshape(h, SHRINK, w, SHRINK).mean((1, 3))


class Prepared:
    """A gray frame and what tracking reads of it, made when it is first asked for and used in both directions."""

    def __init__(self, gray: np.ndarray):
        self.gray, self.levels = gray, None

    def tracked(self) -> list[Level]:
        if self.levels is None:
            if not np.isfinite(self.gray).all():
                raise ValueError("a frame holds values that are not finite")
            self.levels = pyramid(_small(self.gray))
        return self.levels


def track(one: np.ndarray | Prepared, two: np.ndarray | Prepared, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points carried from one gray frame to the next, and which were found again on the way back.

    The others move by the median of those; where none is, by that of the points that came back, though without texture or from
    beyond the frame. Where none came back all stay: refuted moves say nothing, and the search at the batch's end finds a line that is a few pixels off.
    """
    one, two = (f if isinstance(f, Prepared) else Prepared(f) for f in (one, two))
    a, b = one.tracked(), two.tracked()
    p = points / SHRINK
    to, ok = sparse_flow(a, b, p)
    back, ok2 = sparse_flow(b, a, to)
    came = np.sqrt(((back - p) ** 2).sum(1)) < RETURN
    good, move = ok & ok2 & came, to - p
    told = good if good.any() else came
    shift = np.median(move[told], axis=0) if told.any() else np.zeros(2)
    out = np.where(good[:, None], to, p + shift) * SHRINK
    h, w = one.gray.shape
    return np.rint(np.clip(out, 0, [w - 1, h - 1])), good


def search(points: np.ndarray, p: np.ndarray, gray: np.ndarray, reach: int, mode: str | None) -> np.ndarray:
    """``shapes.search_line`` (with a mode) or ``shapes.search_contour`` on one frame's arrays."""
    h, w = p.shape
    closed = mode is None
    before, after = (np.roll(points, k, 0) for k in (1, -1))
    if not closed:
        before[0], after[-1] = points[0], points[-1]
    t = after - before
    t = t / (np.sqrt((t**2).sum(1)) + 1e-8)[:, None]
    n = np.stack([t[:, 1], -t[:, 0]], 1)
    turn = ((n * (points - points.mean(0))).sum(1) < 0) if closed else (n[:, 1] < 0 if mode == "upper_left" else n[:, 1] > 0)
    n[turn] *= -1
    step = np.arange(-reach, reach + 1)
    s = points[:, None] + n[:, None] * step[None, :, None]
    ix, iy = np.rint(s[..., 0]).astype(int), np.rint(s[..., 1]).astype(int)
    ok = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
    ix, iy = np.clip(ix, 0, w - 1), np.clip(iy, 0, h - 1)
    dark = (255.0 - gray[iy, ix]) / 255.0
    if closed:
        score = p[iy, ix] + 0.15 * dark
    else:
        gy, gx = np.gradient(p)
        score = p[iy, ix] + 2 * (gx[iy, ix] * n[:, :1] + gy[iy, ix] * n[:, 1:]) + 1.2 * dark
        sure = np.where((p[iy, ix] > 0.5) & ok, p[iy, ix] - 0.3 * np.abs(step) / max(reach, 1), -1e9)
        score = np.where((sure > -1e9).any(1)[:, None], sure, score)
    best = np.where(ok, score, -1e9).argmax(1)
    out = s[np.arange(len(points)), best]
    out[~ok.any(1)] = points[~ok.any(1)]
    return out


def _smooth(points: np.ndarray) -> np.ndarray:
    taps = gauss(1.0)
    r = len(taps) // 2
    padded = np.pad(points, ((r, r), (0, 0)), "symmetric") if len(points) >= r else np.pad(points, ((r, r), (0, 0)), "edge")
    return sum(t * padded[k : k + len(points)] for k, t in enumerate(taps))


def extend_tips(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """The line with a point at the border beyond each end, along its principal axis; an end on the border already is its own."""
    c = points - points.mean(0)
    axis = np.linalg.svd(c, full_matrices=False)[2][0]
    if (points[-1] - points[0]) @ axis < 0:
        axis = -axis

    def border(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        ways = [max(0.0, ((size - 1 if u[k] > 0 else 0) - p[k]) / u[k]) for k, size in ((0, width), (1, height)) if u[k]]
        return np.clip(p + u * min(ways, default=0.0), 0, [width - 1, height - 1])

    return np.concatenate([[border(points[0], -axis)], points, [border(points[-1], axis)]])


# --- fields of fitted classifiers ---


def columns_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a rasterised polyline and its mean row in each, truncated."""
    p = points.astype(int)
    steps = [np.maximum(1, np.abs(b - a).max()) for a, b in zip(p, p[1:])]
    at = np.concatenate([np.floor((2 * np.arange(n + 1)[:, None] * (b - a) + n) / (2 * n)).astype(int) + a for a, b, n in zip(p, p[1:], steps)])
    at = np.unique(at, axis=0)
    x, where, count = np.unique(at[:, 0], return_inverse=True, return_counts=True)
    return x, np.floor(np.bincount(where, at[:, 1]) / count).astype(int)


def line_labels(points: np.ndarray, gray: np.ndarray, margin: int = 3, band: int = 10) -> np.ndarray:
    """Labels of a region's pixels as ``pixels.line_bands``: 1 on the darker side of the line, 0 on the other, -1 elsewhere."""
    out = np.full(gray.shape, -1)
    x, y = columns_of(points)
    own = (x >= 0) & (x < gray.shape[1])
    if not own.any():
        return out
    away = np.arange(gray.shape[0])[:, None] - y[own]
    sides = []
    for near in ((away >= -(margin + band)) & (away < -margin), (away >= margin) & (away < margin + band)):
        side = np.zeros(gray.shape, bool)
        side[:, x[own]] = near
        sides.append(side)
    above, below = sides
    if above.any() and below.any():
        dark = gray[above].mean() <= gray[below].mean()
        out[above], out[below] = int(dark), int(not dark)
    return out


def inside(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels inside a closed polygon, even-odd, half-open in y."""
    ys, xs = np.mgrid[:height, :width]
    out = np.zeros((height, width), bool)
    p = points.astype(int)
    for a, b in zip(p, np.roll(p, -1, 0)):
        if a[1] != b[1]:
            spans = (ys >= min(a[1], b[1])) & (ys < max(a[1], b[1]))
            out ^= spans & (a[0] + (ys - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= xs)
    return out


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels within ``radius`` of the mask: every row's runs, widened by the disc's width at each row's distance."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    sums = np.concatenate([np.zeros((h, 1), int), np.cumsum(mask, 1)], 1)
    at = np.arange(w)
    for dy in range(-radius, radius + 1):
        r = int((radius * radius - dy * dy) ** 0.5)
        wide = sums[:, np.minimum(at + r + 1, w)] > sums[:, np.maximum(at - r, 0)]
        to, of = slice(max(0, dy), min(h, h + dy)), slice(max(0, -dy), min(h, h - dy))
        out[to] |= wide[of]
    return out


def ring_labels(points: np.ndarray, gray: np.ndarray, band: int = 4) -> np.ndarray:
    """Labels of a region's pixels as ``shapes.boundary_bands``: 1 on the contour's ring, 0 deep inside and far outside, -1 elsewhere."""
    filled = inside(points, *gray.shape)
    outer = grown(filled, band)
    ring = outer & ~(filled & ~grown(~filled, band))
    if ring.sum() < 8:
        ring = outer & ~filled
    out = np.full(gray.shape, -1)
    out[(filled & ~grown(~filled, band + 3)) | ~grown(filled, band + 6)] = 0
    out[ring] = 1
    return out


Box = tuple[int, int, int, int]


def padded(points: np.ndarray, height: int, width: int, pad: int) -> Box:
    """Half-open bounding box (ymin, ymax, xmin, xmax), ``pad`` wider, within the frame."""
    (x0, y0), (x1, y1) = points.min(0).astype(int), points.max(0).astype(int)
    return max(0, y0 - pad), min(height, y1 + pad), max(0, x0 - pad), min(width, x1 + pad)


def band_box(points: np.ndarray, height: int, width: int, band: int = 20) -> Box:
    """The region of tracked points: their columns, and ``band`` rows beyond the line through them."""
    (x0, y0), (x1, y1) = points.min(0), points.max(0)
    return max(0, int(np.floor(y0)) - band), min(height, int(np.ceil(y1)) + band), max(0, int(np.floor(x0))), min(width, int(np.ceil(x1)) + 1)


def centred(points: np.ndarray, box: Box, reach: int = 20) -> Box:
    """The box cut to +-reach around the points' centre; an axis that would get under 4 pixels stays."""
    cx, cy = points.mean(0)
    y0, y1, x0, x1 = max(box[0], int(cy - reach)), min(box[1], int(cy + reach)), max(box[2], int(cx - reach)), min(box[3], int(cx + reach))
    y0, y1 = (y0, y1) if y1 - y0 >= 4 else box[:2]
    return (y0, y1, *((x0, x1) if x1 - x0 >= 4 else box[2:]))


@dataclass(frozen=True)
class Classifier:
    """How a step's field is fitted: forests as in ``forests.fit``, and the steps that are remembered with their falling share.

    With ``fresh`` under 1 a step grows that share of its trees only and keeps the youngest of the step before in its direction, with their shares
    taken anew from its own pixels; a step then costs about that share of a whole fit.
    """

    trees: int = 50
    more_trees: int = 20
    layers: int = 5
    depth: int = 7
    most: int = 5
    decay: float = 0.6
    seed: int = 7
    fresh: float = 1.0


class Samples:
    """Labelled pixels of one frame's region: features of label 1 and of label 0, from which a number is drawn when they are used."""

    def __init__(self, gray: np.ndarray, before: np.ndarray | None, points: np.ndarray, box: Box, closed: bool):
        y0, y1, x0, x1 = box
        self.ones = self.noughts = np.zeros((0, 48), np.float32)
        if y1 - y0 >= 4 and x1 - x0 >= 4:
            label = (ring_labels if closed else line_labels)(points - [x0, y0], gray[y0:y1, x0:x1]).ravel()
            if (label == 1).any() and (label == 0).any():
                f = region_features(gray, before, box)
                self.ones, self.noughts = f[label == 1], f[label == 0]

    def draw(self, most: int | None, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """At most ``most`` rows of label 1 and twice as many of label 0, without replacement: features and labels."""
        n = len(self.ones) if most is None else min(most, len(self.ones))
        m = min(len(self.noughts), 2 * n)
        x = np.concatenate([rng.permutation(self.ones)[:n], rng.permutation(self.noughts)[:m]])
        return x, np.repeat([1, 0], [n, m])


class Memory:
    """One direction's samples: the frames gone through, newest last, and the seed's, which is kept with a full share; and the forests last fitted."""

    def __init__(self, how: Classifier, closed: bool, pinned: Samples | None, layers: list[forests.Layer] | None = None):
        self.how, self.closed, self.pinned, self.layers = how, closed, pinned, layers
        self.past: list[Samples] = []
        self.rng = np.random.default_rng(how.seed)

    def field(self, source: tuple[np.ndarray, np.ndarray | None, np.ndarray, Box], target: tuple[np.ndarray, np.ndarray | None], box: Box) -> np.ndarray | None:
        """The target's field in the box, 0 outside; None where nothing can be fitted."""
        now = Samples(*source, self.closed)
        if not len(now.ones):
            return None
        parts = [now.draw(None, self.rng)]
        if self.pinned is not None:
            parts.append(self.pinned.draw(max(len(now.ones), 4), self.rng))
        parts += [s.draw(max(4, int(len(now.ones) * self.how.decay ** (k + 1))), self.rng) for k, s in enumerate(reversed(self.past))]
        x, y = np.concatenate([p[0] for p in parts]).astype(float), np.concatenate([p[1] for p in parts])
        layers = forests.fit(x, y, self.how.trees, self.how.more_trees, self.how.layers, self.how.depth, self.how.seed, self.layers, self.how.fresh)
        self.layers = layers or self.layers
        if not layers or box[1] - box[0] < 4 or box[3] - box[2] < 4:
            return None
        out = np.zeros(target[0].shape)
        out[box[0] : box[1], box[2] : box[3]] = forests.field(layers, region_features(*target, box).astype(float)).reshape(box[1] - box[0], -1)
        return out

    def keep(self, gray: np.ndarray, before: np.ndarray | None, points: np.ndarray, box: Box) -> None:
        self.past = [*self.past, Samples(gray, before, points, centred(points, box), self.closed)][-self.how.most :]


Resample = Callable[[np.ndarray, int, bool], np.ndarray]


class Follower:
    """One layer's state: its anchor frame and points, the line of the frame before, and the seed's samples.

    ``how`` gives the classifier of the fields (None: the inverse gray value); ``again`` is how a line is resampled after a step.
    """

    def __init__(self, mode: str, n: int, reach: int, how: Classifier | None = None, again: Resample = resample):
        self.closed = mode not in ("upper_left", "lower_right")
        self.mode, self.n, self.reach, self.how, self.again = mode, n, reach, how, again
        self.anchor: np.ndarray | None = None
        self.points = self.before = None
        self.pinned: Samples | None = None
        self.ready: Prepared | None = None
        self.warm: dict[bool, list[forests.Layer] | None] = {}

    def start(self, gray: np.ndarray, seed: np.ndarray) -> np.ndarray:
        points = self.again(seed, self.n, self.closed)
        if not self.closed:
            points = self.refined(points, gray, np.ones(self.n, bool), self.seed_field(gray, points))
        elif self.how:
            self.pinned = Samples(gray, None, points, centred(points, padded(points, *gray.shape, 25)), True)
        self.anchor, self.points, self.before = gray, points, points
        return points

    def seed_field(self, gray: np.ndarray, points: np.ndarray) -> np.ndarray | None:
        """The seed line's own field under a prior that falls with the distance from its centre."""
        if self.how is None:
            return None
        try:
            box = padded(points, *gray.shape, 20)
            p = Memory(self.how, False, None).field((gray, None, points, box), (gray, None), box)
        except Exception:
            LOG.warning("the seed's field failed", exc_info=True)
            return None
        if p is None:
            return None
        c = points.mean(0)
        radius = np.sqrt(((points - c) ** 2).sum(1)).max() + 1
        ys, xs = np.mgrid[: gray.shape[0], : gray.shape[1]]
        p = p * np.exp(-((xs - c[0]) ** 2 + (ys - c[1]) ** 2) / (2 * (0.85 * radius) ** 2))
        return p if p.max() > 0 else None

    def refined(self, points: np.ndarray, gray: np.ndarray, moving: np.ndarray, p: np.ndarray | None = None, reach: int | None = None) -> np.ndarray:
        h, w = gray.shape
        p = (255.0 - gray) / 255.0 if p is None else p
        found = search(points, p, gray, self.reach if reach is None else reach, None if self.closed else self.mode)
        if self.closed:
            return found + 0.35 * ((np.roll(found, 1, 0) + np.roll(found, -1, 0)) / 2 - found)
        found = _smooth(np.where(moving[:, None], found, points))
        return np.where(moving[:, None], np.rint(np.clip(found, 0, [w - 1, h - 1])), points)

    def one_way(self, frames: list[np.ndarray | Prepared], points: np.ndarray, back: bool = False) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        """The line and the field of each frame in turn, the first frame's line given. A step that fails carries the line on, with
        a field of zeros."""
        memory = Memory(self.how, self.closed, self.pinned, self.warm.get(back)) if self.how else None
        frames = [f if isinstance(f, Prepared) else Prepared(f) for f in frames]
        lines, fields, every = [points], [None], [f.gray for f in frames]
        box = padded(points, *every[0].shape, 25 if self.closed else 20)
        if memory:
            memory.keep(every[0], None, points, box)
        for k, (a, b) in enumerate(zip(every, every[1:])):
            before, p = every[k - 1] if k else every[0], None
            try:
                moved, _ = track(frames[k], frames[k + 1], lines[-1])
                if memory:
                    own = band_box(moved, *a.shape)
                    p = memory.field((a, before, lines[-1], own), (b, a), own)
                    if p is None:
                        p = np.zeros(b.shape)
                        p[own[0] : own[1], own[2] : own[3]] = (255.0 - b[own[0] : own[1], own[2] : own[3]]) / 255.0
                    if k + 2 < len(every):  # nothing is fitted after the last step
                        memory.keep(a, before, lines[-1], padded(lines[-1] if self.closed else moved, *a.shape, 25 if self.closed else 20))
            except Exception:
                LOG.warning("a step failed", exc_info=True)
                moved, p = lines[-1], np.zeros(b.shape) if memory else None
            lines.append(self.again(moved, self.n, self.closed))
            fields.append(p)
        if memory:
            self.warm[back] = memory.layers
        return lines, fields

    def batch(self, grays: list[np.ndarray]) -> list[np.ndarray]:
        """The lines of a batch: forward from the anchor, backward from the forward result, their mean, smoothed and refined."""
        first = self.ready if self.ready is not None and self.ready.gray is self.anchor else Prepared(self.anchor)
        every = [first, *map(Prepared, grays)]
        forward, ahead = self.one_way(every, self.points)
        backward, behind = (x[::-1] for x in self.one_way(every[::-1], forward[-1], True))
        out = []
        for k, gray in enumerate(grays, 1):
            h, w = gray.shape
            both = [p for p in (ahead[k], behind[k]) if p is not None]
            p = np.maximum.reduce(both) if both else (255.0 - gray) / 255.0
            mean = 0.5 * (forward[k] + backward[k])
            if self.closed:
                smooth = mean + 0.15 * ((np.roll(mean, 1, 0) + np.roll(mean, -1, 0)) / 2 - mean)
                line = mean if np.sqrt(((smooth - mean) ** 2).sum(1)).max() > 3 * self.reach else smooth
                if p.max() > 0:
                    line = self.refined(line, gray, np.ones(len(line), bool), p, NUDGE)
                line = self.again(line, self.n, True)
            else:
                line = self.again(mean, self.n, False)
                shift = np.sqrt(((line - self.before) ** 2).sum(1))
                a = float(np.clip(0.55 - shift.mean() / 30.0, 0.40, 0.65))
                self.before = line = a * line + (1 - a) * self.before
                line = self.again(extend_tips(self.refined(line, gray, shift > 0.1, p), h, w), self.n, False)
            out.append(line)
        self.anchor, self.points, self.ready = grays[-1], out[-1], every[-1]
        return out


def propagate(frames: DataFrame, seeds: DataFrame, points: int = 60, reach: int = 12, batch: int = 5, how: Classifier | None = None, again: Resample = resample, stop: str | None = None) -> DataFrame:
    """Lines of every frame after a layer's seed: (video_id, layer_id, frame_id, status, strokes).

    ``frames(video_id, frame_id, height, width, data)`` are 8-bit gray; ``seeds(video_id, layer_id, frame_id, edge_mode, pts)`` are the
    guide at a layer's first frame. A frame that can't be read, or a step that fails, carries the last line forward with its error as
    status; other layers go on. Lines are refined in the inverse gray value, or, with ``how``, in fields of forests that each step fits on
    the frame before it and up to ``how.most`` earlier ones; where nothing can be fitted it is the inverse gray value around the line.
    ``again(points, n, closed)`` resamples a line after each step. ``stop`` names a file that all machines reach (``request_stop`` makes it): tasks look for it
    before each batch, and once it is there they do no more; what was done is kept, and ``run_status`` with a plan says stopped.
    """
    own = frames.select("video_id", "frame_id", "height", "width", "data").join(
        seeds.select("video_id", "layer_id", F.col("frame_id").alias("seed_frame"), "edge_mode", "pts"), "video_id",
    ).where("frame_id >= seed_frame")
    # a seed's points travel with its own frame only
    own = own.withColumn("pts", F.when(F.col("frame_id") == F.col("seed_frame"), F.col("pts")))
    # a number of its own, as small tables would be joined into one task, and the work is in the steps and not in the bytes
    dealt = own.repartition(max(DEALT, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "video_id", "layer_id").sortWithinPartitions("video_id", "layer_id", "frame_id")
    schema = "video_id string, " + TIMELINE.replace("strokes", "status string, strokes", 1)

    def emit(r: dict, line: np.ndarray, status: str) -> dict:
        pts = [{"x": float(x), "y": float(y)} for x, y in line]
        return {"video_id": r["video_id"], "layer_id": r["layer_id"], "frame_id": r["frame_id"], "status": status, "strokes": [{"type": "point", "edge_mode": r["edge_mode"], "pts": pts}]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        arrow = pa.schema([("video_id", pa.string()), ("layer_id", pa.string()), ("frame_id", pa.int32()), ("status", pa.string()), ("strokes", pa.list_(pa.struct([("type", pa.string()), ("edge_mode", pa.string()), ("pts", pa.list_(point))])))])
        key, follower, held, halted = None, None, [], False

        def flush() -> list[dict]:
            nonlocal halted
            if not held:
                return []
            halted = halted or (stop is not None and stop_requested(stop))
            if halted:
                held.clear()
                return []
            try:
                lines, status = follower.batch([g for _, g in held]), "ok"
            except Exception as e:  # one layer's failure is a status of its rows
                LOG.warning("a batch failed", exc_info=True)
                lines, status = [follower.points] * len(held), f"failed: {e}"
            out = [emit(r, line, status) for (r, _), line in zip(held, lines)]
            held.clear()
            return out

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                out = []
                if (r["video_id"], r["layer_id"]) != key:
                    out += flush()
                    key, follower = (r["video_id"], r["layer_id"]), None
                data = r.pop("data")
                readable = data is not None and len(data) == r["height"] * r["width"]
                gray = np.frombuffer(data, np.uint8).reshape(r["height"], r["width"]).astype(float) if readable else None
                if follower is None:
                    if gray is not None and r["pts"] and not halted:
                        follower = Follower(r["edge_mode"], points, reach, how, again)
                        out.append(emit(r, follower.start(gray, np.array([(p["x"], p["y"]) for p in r["pts"]], float)), "seed"))
                elif gray is None:
                    out += flush()
                    out += [] if halted else [emit(r, follower.points, "failed: unreadable frame")]
                else:
                    held.append((r, gray))
                    if len(held) == batch:
                        out += flush()
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
        out = flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def request_stop(path: str) -> None:
    """Makes the file that running tasks look for."""
    fs, name = _at(path)
    fs.open_output_stream(name).close()


def stop_requested(path: str) -> bool:
    fs, name = _at(path)
    return fs.get_file_info(name).type != pafs.FileType.NotFound


def run_status(timeline: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Each layer's outcome: frames, failures, and stopped (short of ``planned(video_id, layer_id, last_planned)``), the number of errors,
    or complete. A planned layer without rows is stopped with no frames."""
    bad, keys = F.col("status").startswith("failed"), ["video_id", "layer_id"]
    own = timeline.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if(bad).alias("errors"), F.max("frame_id").alias("last_frame"))
    done = F.when(F.col("errors") == 0, "complete").otherwise(F.concat(F.col("errors").cast("string"), F.lit(" errors")))
    if planned is None:
        return own.withColumn("outcome", done)
    own = planned.select(*keys, "last_planned").join(own, keys, "left").fillna(0, ["frames", "errors"])
    short = F.col("last_frame").isNull() | (F.col("last_frame") < F.col("last_planned"))
    return own.select(*keys, "frames", "errors", "last_frame", F.when(short, "stopped").otherwise(done).alias("outcome"))


def merge_guidelines(guidelines: DataFrame, timeline: DataFrame) -> DataFrame:
    """The guide lines ``(video_id, layer_id, frame_id, strokes)`` after a run: its line where it has one, else the one before."""
    keys = ["video_id", "layer_id", "frame_id"]
    new = timeline.select(*keys, "strokes")
    return guidelines.select(*keys, "strokes").join(new.select(*keys), keys, "left_anti").unionByName(new)
