"""Images as pixel rows (frame_id, x, y, v): scalar functions, masks, neighbourhoods, and what frames add up to.

Neighbourhoods are windows along rows and columns of one frame, so the shuffle is by (frame, row) and (frame, column).
Frames are dense grids where a neighbourhood is read; masks for the other operators may be sparse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.sequences import convolve, gauss

KEYS = ("frame_id",)


def _frame(keys=KEYS):
    return Window.partitionBy(*keys)


def _along(axis: str, keys=KEYS):
    return Window.partitionBy(*keys, "y" if axis == "x" else "x").orderBy(axis)


# --- scalar functions of one pixel ---


def lut(v: Column, lo, hi) -> Column:
    """Linear map of [lo, hi] to 0..255, truncated; v - lo where hi <= lo."""
    lo, hi = F.lit(lo), F.lit(hi)
    clipped = F.least(F.greatest(v, lo), hi)
    return F.when(hi <= lo, clipped - lo).otherwise(F.floor((clipped - lo) / (hi - lo) * 255)).cast("long")


def invert(v: Column) -> Column:
    return F.lit(255) - v


def threshold(v: Column, over=1) -> Column:
    return F.when(v > over, 255).otherwise(0)


def clamp(c: Column, size) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(size) - 1)


def in_bounds(x: Column, y: Column, width, height) -> Column:
    return (x >= 0) & (x < F.lit(width)) & (y >= 0) & (y < F.lit(height))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def blend(base: Column, layers: list[tuple[Column, int, float]]) -> Column:
    """Tints one channel by each layer in turn: base (1 - m a) + tint m a, for (mask as boolean, tint, alpha)."""
    out = base.cast("double")
    for mask, tint, alpha in layers:
        a = F.when(mask, F.lit(alpha)).otherwise(0.0)
        out = out * (1 - a) + F.lit(float(tint)) * a
    return out


# --- per frame ---


def sampled_bounds(df: DataFrame, start: int = 0, end: int | None = None, samples: int = 10, lo=None, hi=None, frame: str = "frame_id") -> DataFrame:
    """Least and greatest value over every max(1, n // samples)-th frame of the range; given bounds win.

    Only those frames' rows are aggregated; the number of frames is the range's, or found from the greatest frame number.
    """
    if end is None:
        end = (df.agg(F.max(frame)).first()[0] or 0) + 1
    if start < 0:
        start = 0
    if end <= start:
        raise ValueError("empty frame range")
    step = max(1, (end - start) // samples)
    own = df.where((F.col(frame) >= start) & (F.col(frame) < end) & ((F.col(frame) - start) % step == 0))
    return own.agg(F.coalesce(F.lit(lo), F.min("v")).alias("lo"), F.coalesce(F.lit(hi), F.max("v")).alias("hi"))


def preview(df: DataFrame, keys=KEYS) -> DataFrame:
    """(v - min) / (max - min + 1e-6) * 255 truncated, in frames whose maximum is over 255; other frames stay."""
    w = _frame(keys)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return df.withColumn("v", F.when(hi > 255, F.floor((F.col("v") - lo) / (hi - lo + 1e-6) * 255)).otherwise(F.col("v")).cast("long"))


def gray(df: DataFrame, keys=KEYS) -> DataFrame:
    """Mean of the channels r, g, b, spread over 0..255 in each frame and truncated; a constant frame is 0."""
    w = _frame(keys)
    df = df.withColumn("_m", (F.col("r") + F.col("g") + F.col("b")) / 3)
    lo, hi = F.min("_m").over(w), F.max("_m").over(w)
    return df.withColumn("v", F.when(hi > lo, F.floor((F.col("_m") - lo) / (hi - lo) * 255)).otherwise(0).cast("long")).drop("_m")


def decode_colour(df: DataFrame, colour: tuple[int, int, int], within: int = 19, keys=KEYS) -> DataFrame:
    """Mask ``v`` of the pixels near a colour in every channel; a frame without one takes those with luma over 1."""
    near = (F.abs(F.col("r") - colour[0]) <= within) & (F.abs(F.col("g") - colour[1]) <= within) & (F.abs(F.col("b") - colour[2]) <= within)
    df = df.withColumn("_near", near.cast("int"))
    some = F.max("_near").over(_frame(keys)) > 0
    light = luma(F.col("r"), F.col("g"), F.col("b")) > 1
    return df.withColumn("v", F.when(F.when(some, F.col("_near") == 1).otherwise(light), 255).otherwise(0)).drop("_near")


def encode_colour(df: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """Channels of a mask file: the layer's colour in the foreground, zeros elsewhere."""
    return df.withColumns({c: F.when(F.col("v") > 0, F.lit(k)).otherwise(0) for c, k in zip("rgb", colour)})


def resize_nearest(df: DataFrame, size: tuple[int, int], to: tuple[int, int], keys=KEYS) -> DataFrame:
    """Nearest-neighbour resize of frames of (width, height) ``size``: each source pixel yields its target pixels, without a join."""
    (sw, sh), (dw, dh) = size, to
    span = lambda c, s, d: F.sequence(F.floor(F.col(c) * d / s).cast("int"), F.least(F.lit(d - 1), F.ceil((F.col(c) + 1) * d / s).cast("int")))
    out = df.select(*keys, "x", "y", "v", F.explode(span("x", sw, dw)).alias("_x")).select("*", F.explode(span("y", sh, dh)).alias("_y"))
    out = out.where((F.floor(F.col("_x") * sw / dw) == F.col("x")) & (F.floor(F.col("_y") * sh / dh) == F.col("y")))
    return out.select(*keys, F.col("_x").cast("long").alias("x"), F.col("_y").cast("long").alias("y"), "v")


def moments(df: DataFrame, keys=KEYS) -> DataFrame:
    """Centre of mass and area of the foreground; frames without any drop out."""
    return df.where("v > 0").groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("area"))


def area(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col("v") > 0).alias("area"))


def extent(df: DataFrame, keys=KEYS) -> DataFrame:
    """Least and greatest column with foreground; 0, 0 without any."""
    fg = F.when(F.col("v") > 0, F.col("x"))
    return df.groupBy(*keys).agg(F.coalesce(F.min(fg), F.lit(0)).alias("min_x"), F.coalesce(F.max(fg), F.lit(0)).alias("max_x"))


def boundary(df: DataFrame, side: str, keys=KEYS) -> DataFrame:
    """For each column with foreground: its largest y ('upper' wall) or its smallest ('lower' wall)."""
    pick = F.max if side == "upper" else F.min
    return df.where("v > 0").groupBy(*keys, "x").agg(pick("y").alias("y"))


def object_radius(df: DataFrame, keys=KEYS) -> DataFrame:
    """Greatest distance of the foreground to its centre, plus 1."""
    w = _frame(keys)
    fg = df.where("v > 0")
    dx, dy = F.col("x") - F.avg("x").over(w), F.col("y") - F.avg("y").over(w)
    return fg.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(*keys).agg((F.max("_d") + 1).alias("radius"))


def spatial_prior(df: DataFrame, factor: float = 0.85, keys=KEYS) -> DataFrame:
    """exp(-d^2 / 2 s^2) around the foreground's centre, s = factor * radius."""
    centre = moments(df, keys).join(object_radius(df, keys), list(keys))
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return df.join(centre, list(keys)).withColumn("prior", F.exp(-d2 / (2 * (factor * F.col("radius")) ** 2))).drop("cx", "cy", "area", "radius")


# --- neighbourhoods ---


def _plus(df: DataFrame, pick, least, keys) -> DataFrame:
    near = [pick("v").over(_along(a, keys).rangeBetween(-1, 1)) for a in "xy"]
    return df.withColumn("v", least(*near))


def dilate_plus(df: DataFrame, keys=KEYS) -> DataFrame:
    """Maximum over a pixel and its four neighbours within the frame."""
    return _plus(df, F.max, F.greatest, keys)


def erode_plus(df: DataFrame, keys=KEYS) -> DataFrame:
    return _plus(df, F.min, F.least, keys)


def close_open(df: DataFrame, keys=KEYS) -> DataFrame:
    """Closing and then opening by the plus shape. Dealt by frame once, which serves the windows along rows and columns alike."""
    return dilate_plus(erode_plus(erode_plus(dilate_plus(df.repartition(*keys), keys), keys), keys), keys)


def runs(df: DataFrame, keys=KEYS) -> DataFrame:
    """Runs of neighbouring pixels of one kind in each row: (keys, y, fg, a, b), from column a to column b."""
    own = df.select(*keys, "y", F.col("x").cast("long").alias("x"), (F.coalesce("v", F.lit(0)) > 0).alias("fg"))
    rank = F.row_number().over(Window.partitionBy(*keys, "y", "fg").orderBy("x"))
    return own.withColumn("_run", F.col("x") - rank).groupBy(*keys, "y", "fg", "_run").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_run")


def widened_runs(own: DataFrame, radii: dict[str, tuple[bool, int]], width: int, height: int, keys=KEYS) -> DataFrame:
    """For each name the runs that its radius makes of foreground (True) or background (False) runs: (keys, name, y, a, b), overlapping.

    A run yields 2 r + 1 rows, its own widened by the disc's width at each distance, and not each pixel's disc.
    """
    rows = [(name, fg, dy, int((r * r - dy * dy) ** 0.5)) for name, (fg, r) in radii.items() for dy in range(-r, r + 1)]
    steps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("fg"), F.lit(d).alias("dy"), F.lit(w).alias("wide")) for n, f, d, w in rows])
    spread = own.select(*keys, "y", "a", "b", F.explode(F.filter(steps, lambda s: s["fg"] == F.col("fg"))).alias("s"))
    spread = spread.select(*keys, "s.name", (F.col("y") + F.col("s.dy")).cast("long").alias("y"), F.greatest(F.col("a") - F.col("s.wide"), F.lit(0)).alias("a"), F.least(F.col("b") + F.col("s.wide"), F.lit(width - 1)).alias("b"))
    return spread.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("a") <= F.col("b")))


def grown_runs(own: DataFrame, radii: dict[str, tuple[bool, int]], width: int, height: int, keys=KEYS) -> DataFrame:
    """For each name the pixels within its radius of foreground (True) or background (False) runs: (keys, name, y, a, b), merged runs."""
    spread = widened_runs(own, radii, width, height, keys)
    w = Window.partitionBy(*keys, "name", "y").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0)
    part = spread.withColumn("_new", opens).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "name", "y", "_part").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_part")


def dilate_disc(df: DataFrame, radius: int, width: int, height: int, keys=KEYS) -> DataFrame:
    """Foreground pixels (sparse) within ``radius`` of foreground, by runs of rows."""
    out = grown_runs(runs(df.where("v > 0"), keys), {"near": (True, radius)}, width, height, keys)
    return out.select(*keys, F.explode(F.sequence("a", "b")).alias("x"), "y")


def erode_disc(df: DataFrame, radius: int, width: int, height: int, keys=KEYS) -> DataFrame:
    """Foreground pixels (sparse) whose disc, as far as it is in the frame, is all foreground. The frame is dense."""
    away = grown_runs(runs(df, keys).where("not fg"), {"away": (False, radius)}, width, height, keys)
    away = away.select(*keys, F.explode(F.sequence("a", "b")).alias("x"), "y")
    return df.where("v > 0").select(*keys, "x", "y").join(away, [*keys, "x", "y"], "left_anti")


def _reflected(c: str, w) -> tuple[Column, Column]:
    """Previous and next value; at an edge, the one on the other side (mirror without repeating the edge)."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))


def sobel(df: DataFrame, keys=KEYS) -> DataFrame:
    """3 x 3 Sobel derivatives gx, gy and their magnitude. Dealt by frame once, as ``close_open``."""
    return _sobel(df.repartition(*keys), keys)


def _sobel(df: DataFrame, keys) -> DataFrame:
    for axis in "xy":
        before, after = _reflected("v", _along(axis, keys))
        df = df.withColumn(f"_d{axis}", after - before)
    for axis, across in (("x", "y"), ("y", "x")):
        before, after = _reflected(f"_d{axis}", _along(across, keys))
        df = df.withColumn(f"g{axis}", before + 2 * F.col(f"_d{axis}") + after)
    return df.withColumn("mag", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).drop("_dx", "_dy")


def gradient(df: DataFrame, column: str = "v", keys=KEYS) -> DataFrame:
    """Central differences inside, one-sided ones at the edges: px, py."""
    for axis in "xy":
        w = _along(axis, keys)
        before, after, own = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
        df = df.withColumn(f"p{axis}", F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2).cast("double"))
    return df


def blur(df: DataFrame, sigma: float, radius: int | None = None, column: str = "v", keys=KEYS) -> DataFrame:
    """Separable Gaussian blur with mirrored edges (the edge itself not repeated), dealt by frame once."""
    taps = gauss(sigma, radius)
    df = df.repartition(*keys).withColumn(column, F.col(column).cast("double"))
    df = convolve(df, [column], taps, (*keys, "y"), "x", "reflect_101")
    return convolve(df, [column], taps, (*keys, "x"), "y", "reflect_101")


def structure_tensor(df: DataFrame, sigma: float = 1.0, radius: int | None = None, keys=KEYS) -> DataFrame:
    """Eigenvalues l1 >= l2 of the blurred products of the Sobel derivatives: tr/2 +- sqrt(max(0, tr^2/4 - det)).

    One exchange: rows dealt by frame serve the windows and groups of its rows and of its columns alike."""
    g = _sobel(df.repartition(*keys), keys).withColumns({"jxx": (F.col("gx") * F.col("gx")).cast("double"), "jyy": (F.col("gy") * F.col("gy")).cast("double"), "jxy": (F.col("gx") * F.col("gy")).cast("double")})
    taps = gauss(sigma, radius)
    three = ["jxx", "jyy", "jxy"]
    g = convolve(g.select(*keys, "x", "y", *three), three, taps, (*keys, "y"), "x", "reflect_101")
    g = convolve(g, three, taps, (*keys, "x"), "y", "reflect_101")
    half = (F.col("jxx") + F.col("jyy")) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("jxx") * F.col("jyy") - F.col("jxy") * F.col("jxy"))))
    return g.select(*keys, "x", "y", (half + root).alias("l1"), (half - root).alias("l2"))


# --- regions and labels ---


def clamp_box(box: DataFrame, centre_x: Column, centre_y: Column, reach: int = 20, least: int = 4) -> DataFrame:
    """Half-open boxes cut to +-reach of a centre; an axis that would get under ``least`` pixels stays."""
    out = {}
    for lo, hi, c in (("ymin", "ymax", centre_y), ("xmin", "xmax", centre_x)):
        a, b = F.greatest(F.col(lo), F.floor(c - reach)), F.least(F.col(hi), F.floor(c + reach) + 1)
        out |= {lo: F.when(b - a < least, F.col(lo)).otherwise(a), hi: F.when(b - a < least, F.col(hi)).otherwise(b)}
    return box.select(*[out[c].alias(c) if c in out else c for c in box.columns])


def line_bands(df: DataFrame, line: DataFrame, margin: int = 3, band: int = 10, keys=KEYS) -> DataFrame:
    """Labels of the pixels beside a line (keys, x, line_y): band 'above' or 'below' it, ``margin`` away; the darker is foreground (1).

    The side with the lower mean value, or the one above at a tie, is the foreground. Other pixels drop out.
    """
    on = df.join(line, [*keys, "x"])
    d = F.col("y") - F.col("line_y")
    side = F.when(d.between(-(margin + band), -(margin + 1)), "above").when(d.between(margin, margin + band - 1), "below")
    on = on.withColumn("side", side).where("side is not null")
    w = _frame(keys)
    above, below = F.avg(F.when(F.col("side") == "above", F.col("v"))).over(w), F.avg(F.when(F.col("side") == "below", F.col("v"))).over(w)
    dark = F.when(F.coalesce(above <= below, above.isNotNull()), "above").otherwise("below")
    return on.withColumn("label", (F.col("side") == dark).cast("int")).drop("line_y")


def column_line(guide: DataFrame, keys=KEYS) -> DataFrame:
    """One y a column from a rasterised guide (keys, x, y): the mean, truncated."""
    return guide.groupBy(*keys, "x").agg(F.floor(F.avg("y")).alias("line_y"))
