"""Ordered point sequences: polylines and contours as rows (frame, node, x, y).

Everything is a window over one frame (or one node), so the only shuffle is by that key; ``keys`` names it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pathloom.shared import streamed

KEYS, ORDER = ("frame_id",), "node_id"


def ordered(keys=KEYS, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys=KEYS, order=ORDER) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def length(dx: Column, dy: Column) -> Column:
    """sqrt(dx^2 + dy^2); unlike hypot it gives the same bits in other engines."""
    return F.sqrt(dx * dx + dy * dy)


def gauss(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised weights of -radius..radius; the radius is int(4 sigma + 0.5) where none is given."""
    r = int(4 * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]


def segments(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Each node's step to the next: dx, dy and length, null at the last node."""
    w = ordered(keys, order)
    df = df.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y"))
    return df.withColumn("seg", length(F.col("dx"), F.col("dy")))


def arc_length(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """``cum``: length of the polyline up to each node, 0 at the first."""
    w = ordered(keys, order)
    step = F.coalesce(length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("cum", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def mean_spacing(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Mean step between neighbouring nodes of each frame."""
    return segments(df, keys, order).groupBy(*keys).agg(F.avg("seg").alias("spacing"))


def _resample(df: DataFrame, n: int, keys, order, closed: bool, least: int) -> DataFrame:
    """Points at equal arc lengths. Each segment yields the points that fall on it, so nothing is joined.

    A segment starts at the very length at which the one before ends, and its points are those counted by the end and not yet by the
    start, so each of the n points falls on one segment whatever the rounding; all windows share one order.
    """
    w, all_ = ordered(keys, order), whole(keys, order)
    to = (lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(all_))) if closed else (lambda c: F.lead(c).over(w))
    df = df.select(*keys, order, "x", "y", to("x").alias("x2"), to("y").alias("y2"), F.count(F.lit(1)).over(all_).alias("n_in"), F.row_number().over(w).alias("_at"))
    df = df.withColumn("seg", F.coalesce(length(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), F.lit(0.0)))
    df = df.withColumn("b", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("a", F.coalesce(F.lag("b").over(w), F.lit(0.0))).withColumn("total", F.last("b").over(all_))
    parts = n if closed else n - 1
    solid = (F.col("n_in") >= least) & (F.col("total") > 0)
    before = lambda c: F.when(F.col(c) >= F.col("total"), n).otherwise(F.ceil(F.col(c) * parts / F.col("total"))).cast("int")  # noqa: E731  (points short of a length)
    first = F.col("_at") == 1  # a line without length has all points at its first node
    df = df.withColumn("_from", F.when(solid, before("a")).otherwise(0)).withColumn("_to", F.when(solid, before("b")).otherwise(F.when(first, n).otherwise(0))).where("_from < _to")
    on = df.select("*", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("i"))
    t = F.least(F.greatest((F.col("i") * F.col("total") / parts - F.col("a")) / F.nullif(F.col("seg"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    point = lambda c: F.when(F.col("n_in") < least, 0.0).when(~solid, F.col(c)).otherwise(F.col(c) + t * (F.col(c + "2") - F.col(c)))
    return on.select(*keys, F.col("i").cast("long").alias("i"), point("x").alias("x"), point("y").alias("y"))


def resample_open(df: DataFrame, n: int, keys=KEYS, order=ORDER) -> DataFrame:
    """``n`` points i = 0..n-1 evenly along a polyline, both ends included. Under 2 nodes: zeros; no length: the first node."""
    return _resample(df, n, keys, order, False, 2)


def resample_closed(df: DataFrame, n: int, keys=KEYS, order=ORDER) -> DataFrame:
    """``n`` points evenly along a closed contour, the end left out. Under 3 nodes: zeros; no length: the first node."""
    return _resample(df, n, keys, order, True, 3)


def interpolate_index(df: DataFrame, n: int, keys=KEYS, order=ORDER) -> DataFrame:
    """``n`` values of x and y at evenly spaced (fractional) node indexes, ends included."""
    w, all_ = ordered(keys, order), whole(keys, order)
    df = df.select(*keys, "x", "y", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(all_).alias("m"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    i = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") * (n - 1)) / F.greatest(F.col("m") - 1, F.lit(1))) - 1).cast("int"), F.least(F.lit(n - 1), F.ceil((F.col("k") + 1) * (n - 1) / F.greatest(F.col("m") - 1, F.lit(1))) + 1).cast("int")))
    df = df.select("*", i.alias("i")).withColumn("pos", F.col("i") * (F.col("m") - 1) / (n - 1)).where(F.floor("pos") == F.col("k"))
    t = F.col("pos") - F.col("k")
    step = lambda c: F.col(c) + F.coalesce(t * (F.col(c + "2") - F.col(c)), F.lit(0.0))
    return df.select(*keys, F.col("i").cast("long").alias("i"), step("x").alias("x"), step("y").alias("y"))


def smooth(df: DataFrame, columns: list[str], sigma: float, keys=KEYS, order=ORDER, edge: str = "nearest") -> DataFrame:
    """Gaussian smoothing of columns along the order. Edges: 'nearest' repeats the end, 'reflect' mirrors it (d c b a | a b c d)."""
    taps = gauss(sigma)
    r, w = len(taps) // 2, ordered(keys, order)
    if edge == "nearest":
        all_ = whole(keys, order)
        def at(c: str, k: int) -> Column:
            if k == 0:
                return F.col(c)
            return F.coalesce(F.lag(c, -k).over(w), F.first(c).over(all_)) if k < 0 else F.coalesce(F.lead(c, k).over(w), F.last(c).over(all_))
        return df.withColumns({c: sum((at(c, k - r) * taps[k] for k in range(1, 2 * r + 1)), at(c, -r) * taps[0]) for c in columns})
    return convolve(df, columns, taps, keys, order, edge)


def convolve(df: DataFrame, columns: list[str], taps: list[float], keys=KEYS, order=ORDER, edge: str = "reflect") -> DataFrame:
    """Weighted sums over neighbours, with mirrored ends: 'reflect' (d c b a | a b c d) or 'reflect_101' (d c b | a b c d).

    The mirrored place depends on the position, so a sequence becomes one array, is transformed, and is taken apart again.
    """
    r = len(taps) // 2
    rest = [c for c in df.columns if c not in (*keys, order, *columns)]
    run = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns, *rest))).alias("_all"))
    n = F.size("_all")
    period = 2 * n if edge == "reflect" else F.greatest(2 * n - 2, F.lit(1))
    back = period - 1 if edge == "reflect" else period
    def one(row: Column, i: Column) -> Column:
        def place(k: int) -> Column:
            m = F.pmod(i + k, period)
            return F.get("_all", F.least(m, back - m))
        near = [place(k - r) for k in range(2 * r + 1)]
        sums = [sum((near[k][c] * taps[k] for k in range(1, 2 * r + 1)), near[0][c] * taps[0]).alias(c) for c in columns]
        return F.struct(row[order].alias(order), *sums, *[row[c].alias(c) for c in rest])
    return run.select(*keys, F.inline(F.transform("_all", one)))


def smooth_frames(df: DataFrame, columns: list[str], sigma: float = 1.5, node=("node_id",), frame: str = "frame_id") -> DataFrame:
    """Gaussian smoothing of each node across frames, by row and not by frame number; nodes with at most 3 frames stay."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*node)) > 3
    kept = df.withColumns({f"_raw_{c}": F.col(c) for c in columns}).withColumn("_many", many)
    out = smooth(kept, columns, sigma, node, frame)
    return out.withColumns({c: F.when(F.col("_many"), F.col(c)).otherwise(F.col(f"_raw_{c}")) for c in columns}).drop("_many", *[f"_raw_{c}" for c in columns])


def moving_average(df: DataFrame, column: str = "y", keys=KEYS, order=ORDER) -> DataFrame:
    """Mean of three neighbours; the ends stay."""
    w = ordered(keys, order)
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    return df.withColumn(column, F.when(before.isNull() | after.isNull(), F.col(column)).otherwise((before + F.col(column) + after) / 3))


def laplacian(df: DataFrame, alpha: float = 0.5, passes: int = 3, keys=KEYS, order=ORDER) -> DataFrame:
    """Passes of p + alpha (mean of both neighbours - p) on a closed contour."""
    w, all_ = ordered(keys, order), whole(keys, order)
    for _ in range(passes):
        near = lambda c: (F.coalesce(F.lag(c).over(w), F.last(c).over(all_)) + F.coalesce(F.lead(c).over(w), F.first(c).over(all_))) / 2
        df = df.withColumns({c: F.col(c) + alpha * (near(c) - F.col(c)) for c in ("x", "y")})
    return df


def normals(df: DataFrame, closed: bool = False, mode: str = "upper_left", keys=KEYS, order=ORDER) -> DataFrame:
    """Unit normals nx, ny by central differences: clamped at a line's ends, cyclic on a contour.

    A line's normals point to y >= 0 for 'upper_left' and to y <= 0 otherwise; a contour's point away from its centroid. A
    point without a direction has the zero normal.
    """
    w, all_ = ordered(keys, order), whole(keys, order)
    ends = (lambda c: (F.last(c).over(all_), F.first(c).over(all_))) if closed else (lambda c: (F.col(c), F.col(c)))
    d = lambda c: F.coalesce(F.lead(c).over(w), ends(c)[1]) - F.coalesce(F.lag(c).over(w), ends(c)[0])
    df = df.withColumn("tx", d("x")).withColumn("ty", d("y")).withColumn("_n", length(F.col("tx"), F.col("ty")))
    unit = lambda c: F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(0.0)
    df = df.withColumn("nx", unit("ty")).withColumn("ny", -unit("tx"))
    if closed:
        turn = F.col("nx") * (F.col("x") - F.avg("x").over(all_)) + F.col("ny") * (F.col("y") - F.avg("y").over(all_)) < 0
    else:
        turn = F.col("ny") < 0 if mode == "upper_left" else F.col("ny") > 0
    return df.withColumn("_turn", turn).withColumns({c: F.when(F.col("_turn"), -F.col(c)).otherwise(F.col(c)) for c in ("nx", "ny")}).drop("tx", "ty", "_n", "_turn")


def principal_axis(df: DataFrame, keys=KEYS) -> DataFrame:
    """Centroid and angle of the principal axis of each frame's points."""
    return df.groupBy(*keys).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("angle"),
    )


def damp(df: DataFrame, limit: float = 3.0, least: int = 5, keys=KEYS) -> DataFrame:
    """Distances from the frame's principal axis become limit * tanh(d / limit), where d > 0.01; frames with fewer than ``least`` nodes stay."""
    w = Window.partitionBy(*keys)
    cx, cy = F.avg("x").over(w), F.avg("y").over(w)
    df = df.withColumns({"_cx": cx, "_cy": cy, "_angle": 0.5 * F.atan2(2 * F.covar_pop("x", "y").over(w), F.var_pop("x").over(w) - F.var_pop("y").over(w)), "_n": F.count(F.lit(1)).over(w)})
    df = df.withColumn("_ux", F.cos("_angle")).withColumn("_uy", F.sin("_angle"))
    df = df.withColumn("_along", (F.col("x") - F.col("_cx")) * F.col("_ux") + (F.col("y") - F.col("_cy")) * F.col("_uy"))
    df = df.withColumn("_px", F.col("x") - F.col("_cx") - F.col("_along") * F.col("_ux")).withColumn("_py", F.col("y") - F.col("_cy") - F.col("_along") * F.col("_uy"))
    df = df.withColumn("_d", length(F.col("_px"), F.col("_py"))).withColumn("_f", limit * F.tanh(F.col("_d") / limit) / F.col("_d"))
    moved = (F.col("_n") >= least) & (F.col("_d") > 0.01)
    to = lambda c: F.when(moved, F.col(f"_c{c}") + F.col("_along") * F.col(f"_u{c}") + F.col("_f") * F.col(f"_p{c}")).otherwise(F.col(c))
    return df.withColumns({"x": to("x"), "y": to("y")}).drop(*[c for c in ("_cx", "_cy", "_angle", "_ux", "_uy", "_along", "_px", "_py", "_d", "_f", "_n")])


def refine(df: DataFrame, limit: float = 3.0, along: float = 1.2, across: float = 1.5, frame: str = "frame_id", node: str = "node_id", keys=()) -> DataFrame:
    """Damping, smoothing along the nodes (frames of at least 5), and smoothing of each node across frames (more than 3)."""
    own = (*keys, frame)
    n = F.count(F.lit(1)).over(Window.partitionBy(*own))
    damped = damp(df, limit, 5, own).withColumn("_many", n >= 5).withColumn("_x", F.col("x")).withColumn("_y", F.col("y"))
    smoothed = smooth(damped, ["x", "y"], along, own, node)
    smoothed = smoothed.withColumns({c: F.when(F.col("_many"), F.col(c)).otherwise(F.col(f"_{c}")) for c in ("x", "y")}).drop("_many", "_x", "_y")
    return smooth_frames(smoothed, ["x", "y"], across, (*keys, node), frame)


def padded_box(df: DataFrame, pad: int, width: int, height: int, keys=KEYS) -> DataFrame:
    """Half-open bounding box of the points, ``pad`` wider on each side, within the image."""
    low = lambda c: F.greatest(F.floor(F.min(c)) - pad, F.lit(0))
    high = lambda c, most: F.least(F.ceil(F.max(c)) + pad + 1, F.lit(most))
    return df.groupBy(*keys).agg(low("y").alias("ymin"), high("y", height).alias("ymax"), low("x").alias("xmin"), high("x", width).alias("xmax"))


def extend_to_border(x: Column, y: Column, ux: Column, uy: Column, width: int, height: int) -> tuple[Column, Column]:
    """Where the ray from (x, y) along (ux, uy) first meets one of the lines of the image's border, moved into the image; the point itself where it meets none."""
    ways = [F.when(u != 0, (F.lit(edge) - p) / u) for p, u, most in ((x, ux, width - 1), (y, uy, height - 1)) for edge in (0.0, float(most))]
    t = F.least(*[F.when(w > 1e-5, w) for w in ways])
    return tuple(F.when(t.isNull(), p).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most - 1.0), p + t * u))) for p, u, most in ((x, ux, width), (y, uy, height)))


def tips(df: DataFrame, width: int, height: int, keys=KEYS, order=ORDER) -> DataFrame:
    """Where each end of the polyline meets the border when it goes on along the principal axis, away from the other end."""
    axis = principal_axis(df, keys)
    ends = df.groupBy(*keys).agg(*[f(c, order).alias(f"{n}_{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("x", "y")])
    both = ends.join(axis, list(keys)).withColumn("ux", F.cos("angle")).withColumn("uy", F.sin("angle"))
    flip = F.when((F.col("b_x") - F.col("a_x")) * F.col("ux") + (F.col("b_y") - F.col("a_y")) * F.col("uy") < 0, -1.0).otherwise(1.0)
    both = both.withColumn("_f", flip)
    ax, ay = extend_to_border(F.col("a_x"), F.col("a_y"), -F.col("_f") * F.col("ux"), -F.col("_f") * F.col("uy"), width, height)
    bx, by = extend_to_border(F.col("b_x"), F.col("b_y"), F.col("_f") * F.col("ux"), F.col("_f") * F.col("uy"), width, height)
    return both.select(*keys, ax.alias("start_x"), ay.alias("start_y"), bx.alias("end_x"), by.alias("end_y"))


def ema(df: DataFrame, base: float = 0.55, scale: float = 30.0, low: float = 0.40, high: float = 0.65, keys=("layer_id",), frame: str = "frame_id", node: str = "node_id") -> DataFrame:
    """Temporal smoothing of whole lines: out = a * line + (1 - a) * previous out, a = clip(base - mean shift / scale, low, high).

    The recurrence runs over a layer's frames in order; layers run in parallel. Sorted frames are streamed, so a task holds one line
    and the line before it. Lines of one layer have equally many nodes; a frame of another size starts anew.
    """
    own = df.where(F.col(frame).isNotNull()).select(*keys, frame, node, F.col("x").cast("double"), F.col("y").cast("double"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer, before = None, None
        for name, rows in streamed(batches, n + 1):
            key = [name.column(i)[0].as_py() for i in range(n)]
            if key != layer:
                layer, before = key, None
            line = pa.Table.from_batches(list(rows)).combine_chunks()
            now = np.stack([line.column(c).to_numpy() for c in (n + 2, n + 3)], 1)
            if before is not None and len(before) == len(now):
                shift = np.sqrt(((now - before) ** 2).sum(1)).mean()
                a = min(high, max(low, base - shift / scale))
                now = a * now + (1 - a) * before
            before = now
            for c in (n + 2, n + 3):
                line = line.set_column(c, line.schema.field(c).name, pa.array(now[:, c - n - 2], from_pandas=True))
            yield from line.to_batches()

    return own.repartition(*keys).sortWithinPartitions(*keys, frame, node).mapInArrow(run, own.schema)
