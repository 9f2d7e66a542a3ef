"""Positions relative to a centreline: anchors on polylines, calibration, trajectories, units and peaks.

All steps are keyed by frame. Targets are one row a frame; nodes are joined to them once and stay partitioned by frame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.sequences import length
from pathloom.shared import gathered, streamed, written

KEYS = ("frame_id",)
FPS, MICRONS = 249.2, 0.04


def nearest_node(nodes: DataFrame, target: DataFrame, keys=KEYS) -> DataFrame:
    """The node of least distance to each frame's target (keys, tx, ty); the first of equals."""
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    best = F.min(F.struct((dx * dx + dy * dy).alias("d2"), "node_id", "x", "y"))
    return nodes.join(target, list(keys)).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.node_id").alias("node_id"), F.col("b.d2").alias("d2"), F.col("b.x").alias("x"), F.col("b.y").alias("y"))


def anchors(nodes: DataFrame, targets: DataFrame, names: tuple[str, ...], keys=KEYS) -> DataFrame:
    """Each frame's polyline seen from several targets at once: ``targets(keys, {name}x, {name}y, ...)`` -> a row a frame with
    {name}_ax, {name}_ay, {name}_frac (see ``anchor``), {name}_d2 and {name}_y of the nearest node, last (node) and spacing.

    The nodes are dealt by frame once; all windows and sums are of that key. A null target has null results.
    """
    w, all_ = Window.partitionBy(*keys).orderBy("node_id"), Window.partitionBy(*keys)
    seg = nodes.select(*keys, "node_id", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    on = seg.join(targets, list(keys))
    ex, ey = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    on = on.withColumn("l2", ex * ex + ey * ey)
    at = lambda n: (F.col(f"{n}x") - F.col("x"), F.col(f"{n}y") - F.col("y"))
    near = {}
    for n in names:
        dx, dy = at(n)
        near[f"{n}_near"] = F.min(F.when(dx.isNotNull() & dy.isNotNull(), F.struct((dx * dx + dy * dy).alias("d2"), "node_id", "x", "y"))).over(all_)
    on = on.withColumns(near)
    found, out = [F.max("node_id").alias("last"), F.avg(length(ex, ey)).alias("spacing")], []
    for n in names:
        dx, dy = at(n)
        close = F.col("node_id").between(F.col(f"{n}_near.node_id") - 1, F.col(f"{n}_near.node_id"))
        t = F.when(F.col("l2") > 0, F.least(F.greatest((dx * ex + dy * ey) / F.col("l2"), F.lit(0.0)), F.lit(1.0)))
        px, py = F.col("x") + t * ex, F.col("y") + t * ey
        gx, gy = F.col(f"{n}x") - px, F.col(f"{n}y") - py
        dd = gx * gx + gy * gy
        best = F.min(F.when(close & (dd < F.col(f"{n}_near.d2")), F.struct(dd.alias("dd"), "node_id", px.alias("px"), py.alias("py"), t.alias("t"))))
        found += [best.alias(f"{n}_s"), F.first(f"{n}_near").alias(f"{n}_n")]
        s, m = f"{n}_s", f"{n}_n"
        out += [F.coalesce(f"{s}.px", f"{m}.x").alias(f"{n}_ax"), F.coalesce(f"{s}.py", f"{m}.y").alias(f"{n}_ay"), F.coalesce(F.col(f"{s}.node_id") + F.col(f"{s}.t"), F.col(f"{m}.node_id").cast("double")).alias(f"{n}_frac"), F.col(f"{m}.d2").alias(f"{n}_d2"), F.col(f"{m}.y").alias(f"{n}_y")]
    return on.groupBy(*keys).agg(*found).select(*keys, "last", "spacing", *out)


def anchor(nodes: DataFrame, target: DataFrame, keys=KEYS) -> DataFrame:
    """The point of the polyline at each frame's target: ax, ay, and its fractional node index.

    Only the segments at the nearest node are tried; one replaces the node when it is strictly closer, the earlier at a tie;
    segments without length are skipped.
    """
    found = anchors(nodes, target.select(*keys, "tx", "ty"), ("t",), keys)
    return found.where("t_ax is not null").select(*keys, F.col("t_ax").alias("ax"), F.col("t_ay").alias("ay"), F.col("t_frac").alias("frac"))


def unit_basis(fx: Column, fy: Column, ax: Column, ay: Column) -> tuple[Column, Column]:
    """Unit vector from the anchor to the landmark; (1, 0) where they are one point."""
    d = length(fx - ax, fy - ay)
    return F.when(d > 0, (fx - ax) / d).otherwise(1.0), F.when(d > 0, (fy - ay) / d).otherwise(0.0)


def trajectory(nodes: DataFrame, particle: DataFrame, landmark: DataFrame, frame: int, special: tuple[float, float]) -> DataFrame:
    """Each frame's longitudinal and transverse position of the particle, relative to a special point.

    nodes(frame_id, node_id, x, y); particle and landmark(frame_id, tx, ty) are centres of mass. The special point
    is given in the calibration frame and is carried to the others in the landmark's local basis. Frames without all
    three inputs drop out; a calibration frame without a centreline or a landmark raises ValueError.

    Two passes over the nodes: the first finds the anchors of landmark and particle and is written, a row a frame; the calibration is
    read from it, one row; the second finds the special point's place.
    """
    both = landmark.select("frame_id", F.col("tx").alias("fx"), F.col("ty").alias("fy")).join(particle.select("frame_id", F.col("tx").alias("px"), F.col("ty").alias("py")), "frame_id", "left")
    a = written(anchors(nodes, both, ("f", "p")).join(both, "frame_id"), "anchors")
    ux, uy = unit_basis(F.col("fx"), F.col("fy"), F.col("f_ax"), F.col("f_ay"))
    a = a.withColumn("ux", ux).withColumn("uy", uy)
    at = a.where(F.col("frame_id") == frame).select("f_ax", "f_ay", "ux", "uy").first()
    if at is None:
        raise ValueError(f"frame {frame} lacks a centreline or a landmark")
    sx, sy = special[0] - at["f_ax"], special[1] - at["f_ay"]
    cx, cy = sx * at["ux"] + sy * at["uy"], -sx * at["uy"] + sy * at["ux"]
    a = a.where("px is not null and py is not null")
    a = a.withColumn("sx", F.col("f_ax") + cx * F.col("ux") - cy * F.col("uy")).withColumn("sy", F.col("f_ay") + cx * F.col("uy") + cy * F.col("ux"))
    k = anchors(nodes, a.select("frame_id", "sx", "sy"), ("s",)).select("frame_id", F.least(F.greatest(F.bround("s_frac"), F.lit(0.0)), F.col("last").cast("double")).alias("k"))
    return a.join(k, "frame_id").select(
        F.col("frame_id").alias("Frame"), ((F.col("p_frac") - F.col("k")) * F.col("spacing")).alias("Longitudinal_From_Special"),
        F.when(F.col("py") <= F.col("p_y"), F.sqrt("p_d2")).otherwise(-F.sqrt("p_d2")).alias("Transverse_Dist"),
        F.col("sx").alias("Special_Node_X"), F.col("sy").alias("Special_Node_Y"),
    )


def convert_units(df: DataFrame, inverted: DataFrame | None = None, key: str = "track", fps: float = FPS, microns: float = MICRONS) -> DataFrame:
    """Seconds and micrometres; the longitudinal axis is turned round unless ``inverted(key, invert)`` says otherwise (small table)."""
    if inverted is None:
        df = df.withColumn("_i", F.lit(True))
    else:
        df = df.join(inverted.select(key, F.col("invert").alias("_i")), key, "left").withColumn("_i", F.coalesce("_i", F.lit(True)))
    sign = F.when(F.col("_i"), -1.0).otherwise(1.0)
    return df.withColumns({"time_s": F.col("Frame") / fps, "longitudinal_um": F.col("Longitudinal") * microns * sign, "transverse_um": F.col("Transverse") * microns}).drop("_i")


def ends(df: DataFrame, key: str = "track") -> DataFrame:
    """First and last row of each trajectory."""
    return df.groupBy(key).agg(*[f(c, "Frame").alias(f"{n}_{c.lower()}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("Longitudinal", "Transverse")], F.min("Frame").alias("first_frame"), F.max("Frame").alias("last_frame"))


def prominent(values: np.ndarray, least: float = 0.1) -> list[tuple[int, float]]:
    """Peaks of a series with their prominence: strict rises to a top (flat tops: their middle) and a fall after it.

    The prominence is the height over the higher of the two minima towards the next strictly higher sample on each side.
    """
    v, n, out = values.tolist(), len(values), []
    peaks, i = [], 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    # minima towards the next higher sample, by a stack of falling values
    def minima(order: range) -> dict[int, float]:
        low, stack = {}, []
        for k in order:
            least_here = v[k]
            while stack and v[stack[-1][0]] <= v[k]:
                least_here = min(least_here, stack.pop()[1])
            low[k] = least_here
            stack.append((k, least_here))
        return low
    left, right = minima(range(n)), minima(range(n - 1, -1, -1))
    for p in peaks:
        h = v[p] - max(left[p], right[p])
        if h >= least:
            out.append((p, h))
    return out


class PeakScan:
    """The peaks that ``prominent`` finds, of a series that is read once, sample by sample; a missing value starts a new series.

    Held are falls, the falling samples so far, each with the least one since the next strictly higher one before it; and open, the
    peaks without a fall of ``least`` and without a higher sample after them yet. Open peaks of one value share their fate.
    """

    def __init__(self, least: float):
        self.least, self.all, self.high = least, [None, None, 0], [None, None, 0]
        self.restart()

    def restart(self) -> None:
        self.falls: list[tuple[float, float]] = []
        self.open: deque[list] = deque()  # [value, first frame, last frame, how many], falling
        self.before: float | None = None
        self.top: list[tuple[int, int | None]] = []  # of a flat top after a rise: places at which frames do not go on by one
        self.size = 0

    def add(self, frame: int | None, value: float | None) -> None:
        if value is None or value != value:
            self.restart()
            return
        if value == self.before:
            if self.top:
                at, start = self.top[-1]
                if frame is None or start is None or frame != start + self.size - at:
                    self.top.append((self.size, frame))
                self.size += 1
            return
        if self.top and value < self.before and self.before - self.falls[-1][1] >= self.least:
            middle = (self.size - 1) // 2
            at, start = next(t for t in reversed(self.top) if t[0] <= middle)
            own = None if start is None else start + middle - at
            if self.open and self.open[-1][0] == self.before:
                self.open[-1][2:] = [own, self.open[-1][3] + 1]
            else:
                self.open.append([self.before, own, own, 1])
        rises = self.before is not None and value > self.before
        self.top, self.size = ([(0, frame)], 1) if rises else ([], 0)
        low = value
        while self.falls and self.falls[-1][0] <= value:
            low = min(low, self.falls.pop()[1])
        self.falls.append((value, low))
        while self.open and self.open[-1][0] < value:
            self.open.pop()
        while self.open and self.open[0][0] - value >= self.least:
            top, first, last, n = self.open.popleft()
            for tally in (self.all, self.high) if top > 0 else (self.all,):
                tally[:] = [first if tally[2] == 0 else tally[0], last, tally[2] + n]
        self.before = value

    def result(self) -> tuple[int | None, int | None, int]:
        first, last, _ = self.high if self.high[2] else self.all
        return first, last, self.all[2]


def peaks(df: DataFrame, key: str = "track", value: str = "Longitudinal", least: float = 0.1) -> DataFrame:
    """Frames of the first and the last peak above zero of each trajectory, else of the first and last peak; null without any.

    Sorted trajectories are streamed; a task holds one trajectory's PeakScan.
    """
    own = df.select(key, F.col("Frame").cast("long").alias("Frame"), F.col(value).cast("double").alias("_value"))
    dealt = own.repartition(key).sortWithinPartitions(key, F.col("Frame").asc_nulls_last())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
        for name, rows in streamed(batches, 1):
            scan = PeakScan(least)
            for b in rows:
                for frame, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    scan.add(frame, v)
            yield name, scan.result()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(scanned(batches), 1, dict.fromkeys(("first_peak", "last_peak", "n_peaks"), pa.int64()))

    kind = dict(df.dtypes)[key]
    return dealt.mapInArrow(run, f"`{key}` {kind}, first_peak long, last_peak long, n_peaks long")
