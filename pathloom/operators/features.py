"""Dense pixel features and motion of image regions, as small numpy kernels that Spark spreads over regions.

A region's features need its own pixels only, so a row (region with its current and previous gray frame) is a unit of work;
a task holds a few rows at a time. Images of one size are worked as one stack of shape (height, images, width): a filter along either
axis is then one product with a banded matrix. A single image may be given as (height, width).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.sequences import gauss

#: Features of one scale: two intensities, six values at each of two blurs, and the flow.
PER_SCALE, SCALES = 16, 3
FLOW_WEIGHT = 0.15
#: Pixels of the boxes that are worked as one stack (a larger box is one by itself), so that a stack's arrays stay in a core's cache.
STACK = 24576


#: Longest side that is correlated by one product with a banded matrix.
SHORT = 256


def correlate(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation of images down their columns (axis 0) or along their rows (axis 1) with mirrored edges (the edge itself not repeated)."""
    n = x.shape[-axis]
    if n <= SHORT:
        m = _banded(n, tuple(taps.tolist()))
        return (m @ x.reshape(n, -1) if axis == 0 else x.reshape(-1, n) @ m.T).reshape(x.shape)
    return _correlate(x, taps, axis and x.ndim - 1)


@lru_cache(maxsize=512)
def _banded(n: int, taps: tuple[float, ...]) -> np.ndarray:
    return _correlate(np.eye(n), np.array(taps), 0)


def _correlate(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    r = len(taps) // 2
    if x.shape[axis] == 1:
        return x * taps.sum()
    while r >= x.shape[axis]:  # the mirror is shorter than the kernel: mirror again
        pad = min(r, x.shape[axis] - 1)
        width = [(pad, pad) if a == axis else (0, 0) for a in range(x.ndim)]
        return _valid(np.pad(np.pad(x, width, "reflect"), [(r - pad, r - pad) if a == axis else (0, 0) for a in range(x.ndim)], "reflect"), taps, axis)
    return _valid(np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(x.ndim)], "reflect"), taps, axis)


def _valid(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis] - len(taps) + 1
    return sum(t * x.take(range(k, k + n), axis) for k, t in enumerate(taps))


def blur(x: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    taps = np.array(gauss(sigma, radius))
    return correlate(correlate(x, taps, 0), taps, 1)


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return correlate(correlate(x, s, 0), d, 1), correlate(correlate(x, d, 0), s, 1)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres at halves."""
    def places(n: int, m: int):
        p = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        a = np.minimum(p.astype(int), max(m - 2, 0))
        return a, np.minimum(a + 1, m - 1), p - a
    a, b, t = places(height, x.shape[0])
    c, d, u = places(width, x.shape[-1])
    t = t.reshape(-1, *[1] * (x.ndim - 1))
    rows = x[a] * (1 - t) + x[b] * t
    return rows[..., c] * (1 - u) + rows[..., d] * u


def polynomials(x: np.ndarray, sigma: float = 1.2, radius: int = 2) -> tuple[np.ndarray, ...]:
    """Quadratic fit of each neighbourhood by Gaussian weights: gradient (b1, b2) and symmetric matrix (a11, a12, a22)."""
    k = np.arange(-radius, radius + 1)
    g = np.exp(-(k**2) / (2 * sigma**2))
    g /= g.sum()
    m2, m4 = float((g * k**2).sum()), float((g * k**4).sum())
    one = [correlate(x, w, 0) for w in (g, g * k, g * k**2)]
    r1, rx, ry = correlate(one[0], g, 1), correlate(one[0], g * k, 1), correlate(one[1], g, 1)
    rxx, ryy, rxy = correlate(one[0], g * k**2, 1), correlate(one[2], g, 1), correlate(one[1], g * k, 1)
    spread = m4 - m2 * m2
    return rx / m2, ry / m2, (rxx - m2 * r1) / spread, rxy / (m2 * m2) / 2, (ryy - m2 * r1) / spread


def dense_flow(before: np.ndarray, after: np.ndarray, levels: int = 3, window: int = 15, rounds: int = 3) -> np.ndarray:
    """Displacement (..., 2) of each pixel from ``before`` to ``after`` by polynomial expansion on an image pyramid of halves."""
    shape = before.shape
    pyramid = [tuple(p.astype(float).reshape(shape[0], -1, shape[-1]) for p in (before, after))]
    while len(pyramid) < levels and min(pyramid[-1][0].shape[::2]) >= 32:
        pyramid.append(tuple(resize(blur(p, 1.0), -(-p.shape[0] // 2), -(-p.shape[2] // 2)) for p in pyramid[-1]))
    u = v = None
    box = np.ones(window) / window
    for one, two in reversed(pyramid):
        h, n, w = one.shape
        u, v = (np.zeros(one.shape), np.zeros(one.shape)) if u is None else (resize(u, h, w) * (w / u.shape[2]), resize(v, h, w) * (h / v.shape[0]))
        first, second = polynomials(one), polynomials(two)
        ys, images, xs = np.ogrid[:h, :n, :w]
        z = np.empty((h, 5, n, w))
        for _ in range(rounds):
            py, px = np.rint(np.clip(ys + v, 0, h - 1)), np.rint(np.clip(xs + u, 0, w - 1))
            at = ((py * n + images) * w + px).astype(np.intp)
            c1, c2, c11, c12, c22 = (p.take(at) for p in second)
            dx, dy = px - xs, py - ys
            a11, a12, a22 = (first[2] + c11) / 2, (first[3] + c12) / 2, (first[4] + c22) / 2
            d1, d2 = (first[0] - c1) / 2 + (a11 * dx + a12 * dy), (first[1] - c2) / 2 + (a12 * dx + a22 * dy)
            cross = a12 * a12
            z[:, 0], z[:, 1], z[:, 2] = a11 * a11 + cross, a12 * (a11 + a22), cross + a22 * a22
            z[:, 3], z[:, 4] = a11 * d1 + a12 * d2, a12 * d1 + a22 * d2
            smooth = correlate(correlate(z, box, 0), box, 1)
            g11, g12, g22, h1, h2 = (smooth[:, k] for k in range(5))
            det = g11 * g22 - g12 * g12
            known = np.abs(det) > 1e-9
            safe = np.where(known, det, 1)
            u, v = np.where(known, (g22 * h1 - g12 * h2) / safe, 0), np.where(known, (g11 * h2 - g12 * h1) / safe, 0)
    return np.stack([u, v], -1).reshape(*shape, 2)


def one_scale(gray: np.ndarray, before: np.ndarray | None) -> Iterator[np.ndarray]:
    """The 16 features of a stack: inverse and plain gray, blurs, gradient magnitudes and structure-tensor eigenvalues at sigma 1 and 3,
    flow. Blurs keep sums, so that of the plain image is 255 less that of the inverse, and their gradients are as large."""
    plain = gray.astype(float)
    dark = 255 - plain
    yield from (dark, plain)
    for sigma in (1.0, 3.0):
        own = blur(dark, sigma)
        gx, gy = sobel(own)
        gxx, gyy = gx * gx, gy * gy
        size = np.sqrt(gxx + gyy)
        yield from (own, 255 - own, size, size)
        xx, yy, xy = blur(gxx, sigma), blur(gyy, sigma), blur(gx * gy, sigma)
        half = (xx + yy) / 2
        root = np.sqrt(np.maximum(0, half * half - (xx * yy - xy * xy)))
        yield from (half + root, half - root)
    flow = np.zeros((*gray.shape, 2)) if before is None else dense_flow(255.0 - before, dark) * FLOW_WEIGHT
    yield from (flow[..., 0], flow[..., 1])


def scales(shape: tuple[int, int], box: tuple[int, int, int, int]) -> list[tuple[slice, slice]]:
    """A half-open box, its middle half and its middle quarter, within a frame of that shape."""
    y0, y1, x0, x1 = box
    cy, cx = (y0 + y1) // 2, (x0 + x1) // 2
    out = [(slice(y0, y1), slice(x0, x1))]
    for scale in (2, 4):
        hh, hw = max(4, (y1 - y0) // (2 * scale)), max(4, (x1 - x0) // (2 * scale))
        out.append((slice(max(0, cy - hh), min(shape[0], cy + hh)), slice(max(0, cx - hw), min(shape[1], cx + hw))))
    return out


def stack_features(gray: list[np.ndarray], before: list[np.ndarray] | None) -> np.ndarray:
    """(regions, pixels, 48) of stacks of boxes, of their middle halves and of their middle quarters, which are enlarged to the boxes."""
    h, n, w = gray[0].shape
    big = lambda z: z if z.shape == (h, n, w) else np.rint(resize(z.astype(float), h, w))
    out = np.empty((n, h, w, SCALES, PER_SCALE), np.float32)
    if n == 1:  # the three scales of one region are a stack too
        alike = lambda cuts: np.concatenate([big(z) for z in cuts], 1)
        for k, values in enumerate(one_scale(alike(gray), None if before is None else alike(before))):
            out[0, ..., k] = values.transpose(0, 2, 1)
        return out.reshape(1, h * w, SCALES * PER_SCALE)
    for s in range(SCALES):
        for k, values in enumerate(one_scale(big(gray[s]), None if before is None else big(before[s]))):
            out[..., s, k] = values.transpose(1, 0, 2)
    return out.reshape(n, h * w, SCALES * PER_SCALE)


def region_features(gray: np.ndarray, before: np.ndarray | None, box: tuple[int, int, int, int]) -> np.ndarray:
    """(pixels, 48) of a half-open box: the box itself, and its middle half and quarter enlarged to it."""
    cut = lambda z: [z[at][:, None] for at in scales(gray.shape, box)]
    return stack_features(cut(gray), None if before is None else cut(before))[0]


FEATURES = "region_id long, x int, y int, v int, features array<float>"


def extract(regions: DataFrame) -> DataFrame:
    """``regions(region_id, height, width, data, before, ymin, ymax, xmin, xmax)``, 8-bit gray frames (before may be null) -> a row
    for each pixel of each box: (region_id, x, y, v, features of 48). Boxes with a side under 4 give no rows."""

    def stacks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        """Regions of a batch that are alike in the sizes of their cuts: (id, box, cuts of the frame, cuts of the one before)."""
        open_: dict[tuple, list[tuple]] = {}
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        small = zip(*(at[c].to_pylist() for c in ("region_id", "height", "width", "ymin", "ymax", "xmin", "xmax")))
        for i, (region, h, w, ymin, ymax, xmin, xmax) in enumerate(small):
            y0, y1, x0, x1 = max(0, ymin), min(h, ymax), max(0, xmin), min(w, xmax)
            if y1 - y0 < 4 or x1 - x0 < 4:
                continue
            cuts = [None if (data := at[c][i].as_buffer()) is None else [np.frombuffer(data, np.uint8).reshape(h, w)[z] for z in scales((h, w), (y0, y1, x0, x1))] for c in ("data", "before")]
            key = (cuts[1] is None, *[z.shape for z in cuts[0]])
            own = open_.setdefault(key, [])
            own.append((region, (y0, y1, x0, x1), *cuts))
            if len(own) >= STACK // ((y1 - y0) * (x1 - x0)):
                yield open_.pop(key)
        yield from open_.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, boxes, gray, before in (zip(*own) for own in stacks(batch)):
                over = lambda cuts: None if cuts[0] is None else [np.stack(z, 1) for z in zip(*cuts)]
                f = stack_features(over(gray), over(before))
                n, pixels, width = f.shape
                places = [np.mgrid[y0:y1, x0:x1].reshape(2, -1) for y0, y1, x0, x1 in boxes]
                ys, xs = np.concatenate(places, 1).astype(np.int32)
                values = np.concatenate([z[0].ravel() for z in gray]).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(n * pixels + 1, dtype=np.int32) * width, pa.array(f.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), pixels)), pa.array(xs), pa.array(ys), pa.array(values), lists], ["region_id", "x", "y", "v", "features"])

    columns = [F.col("region_id").cast("long"), "height", "width", "data", "before", *[F.col(c).cast("int").alias(c) for c in ("ymin", "ymax", "xmin", "xmax")]]
    return regions.select(*columns).mapInArrow(run, FEATURES)
