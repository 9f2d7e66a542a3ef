"""Queries on images."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import pixels as P
from pathloom.operators.sequences import gauss
from pathloom.plans.adapters import colours, tiles, with_
from pathloom.plans.q_sequences import r6, s6


def mask(s, d):
    return tiles(s, d).withColumn("v", P.threshold(F.col("v"), 127))


M = "m0 AS (SELECT frame_id, x, y, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM tile)"


def _plus_sql(source: str, name: str, f: str) -> str:
    g = "greatest" if f == "max" else "least"
    return f"{name} AS (SELECT frame_id, x, y, {g}({f}(v) OVER (PARTITION BY frame_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), {f}(v) OVER (PARTITION BY frame_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM {source})"


CO = ", ".join([M, _plus_sql("m0", "m1", "max"), _plus_sql("m1", "m2", "min"), _plus_sql("m2", "m3", "min"), _plus_sql("m3", "co", "max")])


def _at(expression: str, x: str, y: str) -> str:
    return f"(SELECT {expression} FROM tile q WHERE q.frame_id = t.frame_id AND q.x = {x} AND q.y = {y})"


def _grid(source: str = "tile", column: str = "v") -> str:
    """Each frame as one list, read at any place with mirrored edges."""
    return f"grid AS (SELECT frame_id, list({column} ORDER BY y, x) AS g FROM {source} GROUP BY frame_id)"


def _mir(c: str, k: int) -> str:
    return c if k == 0 else f"least((({c} + {k}) % 14 + 14) % 14, 14 - (({c} + {k}) % 14 + 14) % 14)"


def _px(dx: int, dy: int, g: str = "g") -> str:
    return f"{g}[({_mir('y', dy)}) * 8 + ({_mir('x', dx)}) + 1]"


GX = f"({_px(1, -1)} - {_px(-1, -1)}) + 2 * ({_px(1, 0)} - {_px(-1, 0)}) + ({_px(1, 1)} - {_px(-1, 1)})"
GY = f"({_px(-1, 1)} - {_px(-1, -1)}) + 2 * ({_px(0, 1)} - {_px(0, -1)}) + ({_px(1, 1)} - {_px(1, -1)})"


def _blur_sql(columns: list[str], source: str, sigma: float, out: str) -> str:
    w = gauss(sigma)
    r = len(w) // 2
    line = lambda axis, c: " + ".join(f"{c}s[{_mir(axis, k - r)} + 1] * {w[k]!r}::DOUBLE" for k in range(2 * r + 1))
    lists = lambda axis, by: ", ".join(f"list({c}) OVER (PARTITION BY frame_id, {by} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}s" for c in columns)
    return f"""{out}a AS (SELECT frame_id, x, y, {lists('x', 'y')} FROM {source}),
{out}b AS (SELECT frame_id, x, y, {", ".join(f"{line('x', c)} AS {c}" for c in columns)} FROM {out}a),
{out}c AS (SELECT frame_id, x, y, {lists('y', 'x')} FROM {out}b),
{out} AS (SELECT frame_id, x, y, {", ".join(f"{line('y', c)} AS {c}" for c in columns)} FROM {out}c)"""


def _edge(axis: str) -> str:
    by = "y" if axis == "x" else "x"
    w = f"(PARTITION BY frame_id, {by} ORDER BY {axis})"
    return f"CAST(CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END AS DOUBLE) AS p{axis}"


def _guide(s, d):
    """A slanted line across every tile."""
    return tiles(s, d).where("y = 0").select("frame_id", "x", (F.col("frame_id") % 4 + F.floor(F.col("x") / 3) + 1).alias("line_y"))


LINE = "gl AS (SELECT frame_id, x, frame_id % 4 + x // 3 + 1 AS line_y FROM tile WHERE y = 0)"

QUERIES = {
    "tile_threshold": (lambda s, d: mask(s, d), f"{with_('tile')}, {M} SELECT frame_id, x, y, v FROM m0"),
    "tile_invert": (lambda s, d: tiles(s, d).withColumn("v", P.invert(F.col("v"))), f"{with_('tile')} SELECT frame_id, x, y, 255 - v AS v FROM tile"),
    "tile_lut": (
        lambda s, d: tiles(s, d).withColumn("v", P.lut(F.col("v"), 97, 150)),
        f"{with_('tile')} SELECT frame_id, x, y, CAST(floor((least(greatest(v, 97), 150) - 97) / 53::DOUBLE * 255) AS BIGINT) AS v FROM tile",
    ),
    "lut_sampled_minmax": (
        lambda s, d: P.sampled_bounds(tiles(s, d)),
        f"{with_('tile')}, n AS (SELECT greatest(1, (max(frame_id) + 1) // 10) AS step FROM tile) SELECT min(v) AS lo, max(v) AS hi FROM tile, n WHERE frame_id % step = 0",
    ),
    "tile_preview": (
        lambda s, d: P.preview(tiles(s, d).withColumn("v", F.col("v") * 40)),
        f"{with_('tile')}, b AS (SELECT *, v * 40 AS w, min(v * 40) OVER (PARTITION BY frame_id) AS lo, max(v * 40) OVER (PARTITION BY frame_id) AS hi FROM tile) SELECT frame_id, x, y, CAST(CASE WHEN hi > 255 THEN floor((w - lo) / (hi - lo + 1e-6::DOUBLE) * 255) ELSE w END AS BIGINT) AS v FROM b",
    ),
    "tile_gray": (
        lambda s, d: P.gray(colours(s, d)).select("frame_id", "x", "y", "v"),
        f"{with_('rgb')}, m AS (SELECT *, (r + g + b) / 3 AS m FROM rgb), n AS (SELECT *, min(m) OVER (PARTITION BY frame_id) AS lo, max(m) OVER (PARTITION BY frame_id) AS hi FROM m) SELECT frame_id, x, y, CAST(CASE WHEN hi > lo THEN floor((m - lo) / (hi - lo) * 255) ELSE 0 END AS BIGINT) AS v FROM n",
    ),
    "tile_colour_key": (
        lambda s, d: P.decode_colour(colours(s, d), (127, 121, 115)).select("frame_id", "x", "y", "v"),
        f"{with_('rgb')}, k AS (SELECT *, abs(r - 127) <= 19 AND abs(g - 121) <= 19 AND abs(b - 115) <= 19 AS near FROM rgb), l AS (SELECT *, max(CAST(near AS INT)) OVER (PARTITION BY frame_id) AS any_near FROM k) SELECT frame_id, x, y, CASE WHEN (any_near > 0 AND near) OR (any_near = 0 AND 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b > 1) THEN 255 ELSE 0 END AS v FROM l",
    ),
    "tile_encode_colour": (
        lambda s, d: P.encode_colour(mask(s, d), (255, 64, 0)),
        f"{with_('tile')}, {M} SELECT frame_id, x, y, v, CASE WHEN v > 0 THEN 255 ELSE 0 END AS r, CASE WHEN v > 0 THEN 64 ELSE 0 END AS g, 0 AS b FROM m0",
    ),
    "tile_blend": (
        lambda s, d: tiles(s, d).select("frame_id", "x", "y", P.blend(F.col("v"), [(F.col("v") > 127, 255, 0.5), (F.col("x") > F.col("y"), 0, 0.25)]).alias("v")),
        f"{with_('tile')}, a AS (SELECT *, CASE WHEN v > 127 THEN 0.5::DOUBLE ELSE 0 END AS a1, CASE WHEN x > y THEN 0.25::DOUBLE ELSE 0 END AS a2 FROM tile) SELECT frame_id, x, y, (v * (1 - a1) + 255 * a1) * (1 - a2) + 0 * a2 AS v FROM a",
    ),
    "tile_resize": (
        lambda s, d: P.resize_nearest(tiles(s, d), (8, 8), (12, 5)),
        f"{with_('tile')} SELECT frame_id, i AS x, j AS y, v FROM tile JOIN range(12) t(i) ON x = i * 8 // 12 JOIN range(5) u(j) ON y = j * 8 // 5",
    ),
    "tile_area": (lambda s, d: P.area(mask(s, d)), f"{with_('tile')} SELECT frame_id, count(*) FILTER (WHERE v > 127) AS area FROM tile GROUP BY frame_id"),
    "tile_moments": (
        lambda s, d: r6(P.moments(mask(s, d)), "cx", "cy"),
        f"{with_('tile')} SELECT frame_id, {s6('avg(x)', 'cx')}, {s6('avg(y)', 'cy')}, count(*) AS area FROM tile WHERE v > 127 GROUP BY frame_id",
    ),
    "tile_extent": (
        lambda s, d: P.extent(mask(s, d)),
        f"{with_('tile')} SELECT frame_id, coalesce(min(x) FILTER (WHERE v > 127), 0) AS min_x, coalesce(max(x) FILTER (WHERE v > 127), 0) AS max_x FROM tile GROUP BY frame_id",
    ),
    "tile_radius": (
        lambda s, d: r6(P.object_radius(mask(s, d)), "radius"),
        f"{with_('tile')}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY frame_id) AS dx, y - avg(y) OVER (PARTITION BY frame_id) AS dy FROM tile WHERE v > 127) SELECT frame_id, {s6('max(sqrt(dx * dx + dy * dy)) + 1', 'radius')} FROM c GROUP BY frame_id",
    ),
    "tile_prior": (
        lambda s, d: r6(P.spatial_prior(mask(s, d)), "prior").select("frame_id", "x", "y", "prior"),
        f"{with_('tile')}, c AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy FROM tile WHERE v > 127 GROUP BY frame_id), r AS (SELECT frame_id, any_value(cx) AS cx, any_value(cy) AS cy, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) + 1 AS r FROM tile JOIN c USING (frame_id) WHERE v > 127 GROUP BY frame_id) SELECT frame_id, x, y, {s6('exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * (0.85::DOUBLE * r) * (0.85::DOUBLE * r)))', 'prior')} FROM tile JOIN r USING (frame_id)",
    ),
    "tile_close_open": (lambda s, d: P.close_open(mask(s, d)), f"{with_('tile')}, {CO} SELECT frame_id, x, y, v FROM co"),
    "tile_boundary_upper": (lambda s, d: P.boundary(P.close_open(mask(s, d)), "upper"), f"{with_('tile')}, {CO} SELECT frame_id, x, max(y) AS y FROM co WHERE v > 0 GROUP BY frame_id, x"),
    "tile_boundary_lower": (lambda s, d: P.boundary(P.close_open(mask(s, d)), "lower"), f"{with_('tile')}, {CO} SELECT frame_id, x, min(y) AS y FROM co WHERE v > 0 GROUP BY frame_id, x"),
    "tile_dilate_disc": (
        lambda s, d: P.dilate_disc(mask(s, d), 2, 8, 8),
        f"{with_('tile')} SELECT DISTINCT a.frame_id, a.x, a.y FROM tile a JOIN tile b ON a.frame_id = b.frame_id AND b.v > 127 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4",
    ),
    "tile_erode_disc": (
        lambda s, d: P.erode_disc(mask(s, d), 1, 8, 8),
        f"{with_('tile')} SELECT a.frame_id, a.x, a.y FROM tile a WHERE a.v > 127 AND NOT EXISTS (SELECT 1 FROM tile b WHERE a.frame_id = b.frame_id AND b.v <= 127 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1)",
    ),
    "tile_sobel": (
        lambda s, d: r6(P.sobel(tiles(s, d)), "mag").select("frame_id", "x", "y", "gx", "gy", "mag"),
        f"{with_('tile')}, {_grid()}, s AS (SELECT frame_id, x, y, {GX} AS gx, {GY} AS gy FROM tile JOIN grid USING (frame_id)) SELECT frame_id, x, y, gx, gy, {s6('sqrt(gx * gx + gy * gy)', 'mag')} FROM s",
    ),
    "tile_gradient": (lambda s, d: P.gradient(tiles(s, d)).select("frame_id", "x", "y", "px", "py"), f"{with_('tile')} SELECT frame_id, x, y, {_edge('x')}, {_edge('y')} FROM tile"),
    "tile_blur": (lambda s, d: r6(P.blur(tiles(s, d), 1.0), "v").select("frame_id", "x", "y", "v"), f"{with_('tile')}, {_blur_sql(['v'], 'tile', 1.0, 'bl')} SELECT frame_id, x, y, {s6('v', 'v')} FROM bl"),
    "tile_structure": (
        lambda s, d: P.structure_tensor(tiles(s, d)).select("frame_id", "x", "y", F.round("l1", 4).alias("l1"), (F.round("l2", 4) + 0.0).alias("l2")),
        f"""{with_('tile')}, {_grid()}, s AS (SELECT frame_id, x, y, {GX} AS gx, {GY} AS gy FROM tile JOIN grid USING (frame_id)),
j AS (SELECT frame_id, x, y, CAST(gx * gx AS DOUBLE) AS jxx, CAST(gy * gy AS DOUBLE) AS jyy, CAST(gx * gy AS DOUBLE) AS jxy FROM s), {_blur_sql(['jxx', 'jyy', 'jxy'], 'j', 1.0, 'bj')},
e AS (SELECT *, (jxx + jyy) / 2 AS h FROM bj), f AS (SELECT *, sqrt(greatest(0.0, h * h - (jxx * jyy - jxy * jxy))) AS q FROM e)
SELECT frame_id, x, y, round(h + q, 4) AS l1, round(h - q, 4) + 0.0 AS l2 FROM f""",
    ),
    "bg_fg_bands": (
        lambda s, d: P.line_bands(tiles(s, d), _guide(s, d), 1, 3).select("frame_id", "x", "y", "side", "label"),
        f"""{with_('tile')}, {LINE}, b AS (SELECT frame_id, x, y, v, CASE WHEN y - line_y BETWEEN -4 AND -2 THEN 'above' WHEN y - line_y BETWEEN 1 AND 3 THEN 'below' END AS side FROM tile JOIN gl USING (frame_id, x)),
w AS (SELECT *, avg(v) FILTER (WHERE side = 'above') OVER (PARTITION BY frame_id) AS a, avg(v) FILTER (WHERE side = 'below') OVER (PARTITION BY frame_id) AS l FROM b)
SELECT frame_id, x, y, side, CAST(side = CASE WHEN coalesce(a <= l, a IS NOT NULL) THEN 'above' ELSE 'below' END AS INT) AS label FROM w WHERE side IS NOT NULL""",
    ),
    "tile_box_clamp": (
        lambda s, d: P.clamp_box(P.moments(mask(s, d)).select("frame_id", "cx", "cy", F.lit(0).alias("ymin"), F.lit(8).alias("ymax"), F.lit(0).alias("xmin"), F.lit(8).alias("xmax")), F.col("cx"), F.col("cy"), 2).select("frame_id", *[F.col(c).cast("long").alias(c) for c in ("ymin", "ymax", "xmin", "xmax")]),
        f"""{with_('tile')}, c AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy FROM tile WHERE v > 127 GROUP BY frame_id),
b AS (SELECT frame_id, greatest(0, CAST(floor(cy - 2) AS BIGINT)) AS y0, least(8, CAST(floor(cy + 2) AS BIGINT) + 1) AS y1, greatest(0, CAST(floor(cx - 2) AS BIGINT)) AS x0, least(8, CAST(floor(cx + 2) AS BIGINT) + 1) AS x1 FROM c)
SELECT frame_id, CASE WHEN y1 - y0 < 4 THEN 0 ELSE y0 END AS ymin, CASE WHEN y1 - y0 < 4 THEN 8 ELSE y1 END AS ymax, CASE WHEN x1 - x0 < 4 THEN 0 ELSE x0 END AS xmin, CASE WHEN x1 - x0 < 4 THEN 8 ELSE x1 END AS xmax FROM b""",
    ),
}
