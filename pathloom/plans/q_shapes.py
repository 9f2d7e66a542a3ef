"""Queries on shapes: lines and polygons on pixels, edits of masks by mode, searches along normals, centrelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import centerline as L
from pathloom.operators import pixels as P
from pathloom.operators import shapes as G
from pathloom.plans.adapters import nodes, table, tiles, with_
from pathloom.plans.q_pixels import CO, M, mask
from pathloom.plans.q_sequences import r6, s6

#: Frames of these grids are 8 x 8 tiles; shapes have six points each.
SIDE, CORNERS = 8, 6


def shape_points(s, d):
    """Six points a frame around the tile's middle, from the vector's label and id: (frame_id, seq, x, y)."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(CORNERS - 1))).alias("seq"))
    x = F.element_at(F.array(*[F.lit(v) for v in (1, 4, 6, 6, 4, 1)]), F.col("seq") + 1) + (F.col("frame_id") * (F.col("seq") + 3)) % 3 - 1
    y = F.element_at(F.array(*[F.lit(v) for v in (1, 0, 2, 5, 7, 5)]), F.col("seq") + 1) + (F.col("frame_id") * (F.col("seq") + 5)) % 2
    return e.select("frame_id", F.col("seq").cast("long").alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y"))


SP = "sp AS (SELECT vec_id AS frame_id, q AS seq, [1, 4, 6, 6, 4, 1][q + 1] + (vec_id * (q + 3)) % 3 - 1 AS x, [1, 0, 2, 5, 7, 5][q + 1] + (vec_id * (q + 5)) % 2 AS y FROM embeddings, range(6) t(q))"


def _edges(closed: bool) -> str:
    w = "(PARTITION BY frame_id ORDER BY seq)"
    to = lambda c: f"coalesce(lead({c}) OVER {w}, first_value({c}) OVER {w})" if closed else f"lead({c}) OVER {w}"
    return f"SELECT frame_id, x, y, {to('x')} AS x2, {to('y')} AS y2 FROM sp"


def _raster(name: str, closed: bool) -> str:
    at = lambda c: f"CAST(floor((2 * k * ({c}2 - {c}) + n) / (2.0 * n)) AS BIGINT) + {c}"
    return f"""{name}e AS (SELECT *, greatest(abs(x2 - x), abs(y2 - y), 1) AS n FROM ({_edges(closed)}) WHERE x2 IS NOT NULL),
{name} AS (SELECT DISTINCT frame_id, {at('x')} AS x, {at('y')} AS y FROM (SELECT *, unnest(range(n + 1)) AS k FROM {name}e))
"""


#: Parity of the edges to the left of a pixel, or on an edge's raster.
FILL = f"""{with_('tile')}, {SP}, {_raster('rc', True)}, ed AS ({_edges(True)}),
par AS (SELECT t.frame_id, t.x, t.y, count(*) FILTER (WHERE ed.y <> ed.y2 AND t.y >= least(ed.y, ed.y2) AND t.y < greatest(ed.y, ed.y2) AND ed.x + (t.y - ed.y) * (ed.x2 - ed.x) / (ed.y2 - ed.y)::DOUBLE < t.x) AS l,
  count(*) FILTER (WHERE ed.y <> ed.y2 AND t.y >= least(ed.y, ed.y2) AND t.y < greatest(ed.y, ed.y2) AND ed.x + (t.y - ed.y) * (ed.x2 - ed.x) / (ed.y2 - ed.y)::DOUBLE = t.x) AS o FROM tile t JOIN ed USING (frame_id) GROUP BY ALL),
fp AS (SELECT frame_id, x, y FROM par WHERE l % 2 = 1 OR o > 0 UNION SELECT frame_id, x, y FROM rc WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7)"""


def _mode(m: str):
    new = {"hole_fill": "CASE WHEN fp.x IS NOT NULL THEN 255 ELSE m0.v END", "hole_crop": "CASE WHEN fp.x IS NOT NULL THEN 0 ELSE m0.v END", "object": "CASE WHEN fp.x IS NOT NULL THEN 255 ELSE 0 END"}[m]
    return (
        lambda s, d: G.apply_mode(mask(s, d), shape_points(s, d), m, SIDE, SIDE).select("frame_id", "x", "y", "v"),
        f"{FILL}, {M} SELECT m0.frame_id, m0.x, m0.y, CAST({new} AS INT) AS v FROM m0 LEFT JOIN fp ON fp.frame_id = m0.frame_id AND fp.x = m0.x AND fp.y = m0.y",
    )


def guide(s, d):
    """A line over columns 1..6 of each tile."""
    f = F.col("vec_id")
    return table(s, d, "embeddings").select(f.alias("frame_id"), F.posexplode(F.array(*[F.lit(v) for v in (1, 3, 6)])).alias("seq", "x"), F.col("vec_id")).select("frame_id", F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), (2 + (F.col("frame_id") * (F.col("seq") + 1)) % 4).cast("double").alias("y"))


GL = f"""sp AS (SELECT vec_id AS frame_id, q AS seq, [1, 3, 6][q + 1] AS x, 2 + (vec_id * (q + 1)) % 4 AS y FROM embeddings, range(3) t(q)), {_raster('rl', False)},
cl AS (SELECT frame_id, x, CAST(floor(avg(y)) AS BIGINT) AS line_y FROM rl GROUP BY frame_id, x)"""


def _clip(mode: str):
    up = mode == "upper_left"
    f, pick = ("<", "min") if up else (">", "max")
    sql = f"""{with_('tile')}, {GL}, {CO.replace('m0 AS (SELECT frame_id, x, y, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM tile)', f'm0 AS (SELECT t.frame_id, t.x, t.y, CASE WHEN v > 127 AND NOT coalesce(t.y {f} line_y, false) THEN 255 ELSE 0 END AS v FROM tile t LEFT JOIN cl USING (frame_id, x))')},
bd AS (SELECT frame_id, x, {pick}(y) AS y FROM co WHERE v > 0 GROUP BY frame_id, x),
sm AS (SELECT frame_id, x, CAST(floor(CASE WHEN lag(y) OVER w IS NULL OR lead(y) OVER w IS NULL THEN y ELSE (lag(y) OVER w + y + lead(y) OVER w) / 3.0::DOUBLE END) AS BIGINT) AS edge_y FROM bd WINDOW w AS (PARTITION BY frame_id ORDER BY x))
SELECT m0.frame_id, m0.x, m0.y, CAST(CASE WHEN line_y IS NULL THEN m0.v WHEN edge_y IS NULL THEN CASE WHEN m0.y {'>=' if up else '<='} line_y THEN 255 ELSE m0.v END WHEN m0.y BETWEEN least(edge_y, line_y) AND greatest(edge_y, line_y) THEN 255 ELSE m0.v END AS INT) AS v
FROM m0 LEFT JOIN cl USING (frame_id, x) LEFT JOIN sm USING (frame_id, x)"""
    return lambda s, d: G.apply_mode(mask(s, d), guide(s, d), mode, SIDE, SIDE).select("frame_id", "x", "y", F.col("v").cast("int").alias("v")), sql


def field(s, d):
    return tiles(s, d).withColumn("p", F.col("v") / 255.0)


REACH = 2
_W = "(PARTITION BY frame_id ORDER BY seq)"
_SEARCH_POINTS = f"""tn AS (SELECT *, coalesce(lead(x) OVER {_W}, x) - coalesce(lag(x) OVER {_W}, x) AS tx, coalesce(lead(y) OVER {_W}, y) - coalesce(lag(y) OVER {_W}, y) AS ty FROM sp),
nn AS (SELECT frame_id, seq, x::DOUBLE AS x, y::DOUBLE AS y, ty / sqrt((tx * tx + ty * ty)::DOUBLE) AS nx, -tx / sqrt((tx * tx + ty * ty)::DOUBLE) AS ny FROM tn),
nf AS (SELECT frame_id, seq, x, y, CASE WHEN ny < 0 THEN -nx ELSE nx END AS nx, CASE WHEN ny < 0 THEN -ny ELSE ny END AS ny FROM nn)"""
SEARCH_LINE = f"""{with_('tile')}, {GL}, {_SEARCH_POINTS},
pf AS (SELECT frame_id, x, y, v, v / 255.0::DOUBLE AS p FROM tile),
gr AS (SELECT *, CASE WHEN lag(p) OVER a IS NULL THEN lead(p) OVER a - p WHEN lead(p) OVER a IS NULL THEN p - lag(p) OVER a ELSE (lead(p) OVER a - lag(p) OVER a) / 2 END AS px,
  CASE WHEN lag(p) OVER b IS NULL THEN lead(p) OVER b - p WHEN lead(p) OVER b IS NULL THEN p - lag(p) OVER b ELSE (lead(p) OVER b - lag(p) OVER b) / 2 END AS py FROM pf WINDOW a AS (PARTITION BY frame_id, y ORDER BY x), b AS (PARTITION BY frame_id, x ORDER BY y)),
sa AS (SELECT nf.*, st, x + nx * st AS sx, y + ny * st AS sy FROM nf, range(-{REACH}, {REACH + 1}) t(st)),
sc AS (SELECT sa.*, CASE WHEN p > 0.5::DOUBLE THEN p - 0.3::DOUBLE * (abs(st) / {REACH}.0::DOUBLE) END AS c, p + 2.0::DOUBLE * (px * nx + py * ny) + 1.2::DOUBLE * ((255.0::DOUBLE - v) / 255.0::DOUBLE) AS q FROM sa LEFT JOIN gr ON gr.frame_id = sa.frame_id AND gr.x = round_even(sx, 0) AND gr.y = round_even(sy, 0)),
bs AS (SELECT frame_id, seq, any_value(x) AS x, any_value(y) AS y, CASE WHEN max(c) IS NOT NULL THEN arg_max(sx, (c, -st)) FILTER (WHERE c IS NOT NULL) ELSE arg_max(sx, (q, -st)) FILTER (WHERE q IS NOT NULL) END AS bestx, CASE WHEN max(c) IS NOT NULL THEN arg_max(sy, (c, -st)) FILTER (WHERE c IS NOT NULL) ELSE arg_max(sy, (q, -st)) FILTER (WHERE q IS NOT NULL) END AS besty FROM sc GROUP BY frame_id, seq)
SELECT frame_id, seq, {s6('coalesce(bestx, x)', 'x')}, {s6('coalesce(besty, y)', 'y')} FROM bs"""
_CW = "(PARTITION BY frame_id ORDER BY seq)"
SEARCH_CONTOUR = f"""{with_('tile')}, {SP},
cc AS (SELECT *, avg(x) OVER (PARTITION BY frame_id) AS mx, avg(y) OVER (PARTITION BY frame_id) AS my, coalesce(lead(x) OVER {_CW}, first_value(x) OVER {_CW}) - coalesce(lag(x) OVER {_CW}, last_value(x) OVER (PARTITION BY frame_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS tx,
  coalesce(lead(y) OVER {_CW}, first_value(y) OVER {_CW}) - coalesce(lag(y) OVER {_CW}, last_value(y) OVER (PARTITION BY frame_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ty FROM sp),
n1 AS (SELECT *, CASE WHEN tx <> 0 OR ty <> 0 THEN ty / sqrt((tx * tx + ty * ty)::DOUBLE) ELSE 0 END AS nx, CASE WHEN tx <> 0 OR ty <> 0 THEN -(tx / sqrt((tx * tx + ty * ty)::DOUBLE)) ELSE 0 END AS ny FROM cc),
n2 AS (SELECT frame_id, seq, x, y, CASE WHEN nx * (x - mx) + ny * (y - my) < 0 THEN -nx ELSE nx END AS nx, CASE WHEN nx * (x - mx) + ny * (y - my) < 0 THEN -ny ELSE ny END AS ny FROM n1),
sa AS (SELECT n2.*, st, x + nx * st AS sx, y + ny * st AS sy FROM n2, range(-{REACH}, {REACH + 1}) t(st)),
sc AS (SELECT sa.*, v / 255.0::DOUBLE + 0.15::DOUBLE * ((255.0::DOUBLE - v) / 255.0::DOUBLE) AS q FROM sa LEFT JOIN tile t ON t.frame_id = sa.frame_id AND t.x = round_even(sx, 0) AND t.y = round_even(sy, 0))
SELECT frame_id, seq, {s6('coalesce(arg_max(sx, (q, -st)) FILTER (WHERE q IS NOT NULL), any_value(x))', 'x')}, {s6('coalesce(arg_max(sy, (q, -st)) FILTER (WHERE q IS NOT NULL), any_value(y))', 'y')} FROM sc GROUP BY frame_id, seq"""


# --- centreline: a frame's even nodes as one wall, the odd ones as the other ---

NODES = 64


def walls(s, d):
    n = nodes(s, d).select("frame_id", "node_id", F.col("node_id").cast("double").alias("x"), "y")
    upper = n.where("node_id % 2 = 0").select("frame_id", (F.col("node_id") / 2).cast("long").alias("x"), "y")
    lower = n.where("node_id % 2 = 1").select("frame_id", ((F.col("node_id") - 1) / 2).cast("long").alias("x"), (F.col("y") + 40.0).alias("y"))
    return upper, lower


def _fit(s, d):
    u, lo = walls(s, d)
    return r6(L.fitted(L.mean_curve(u, lo, NODES), NODES), "x", "y").select("frame_id", "i", "x", "y")


def _interp(source: str, name: str) -> str:
    return f"""{name}k AS (SELECT frame_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS m, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {source} WINDOW w AS (PARTITION BY frame_id ORDER BY x)),
{name} AS (SELECT frame_id, i, x + coalesce((i * (m - 1) / {NODES - 1}.0::DOUBLE - k) * (x2 - x), 0) AS x, y + coalesce((i * (m - 1) / {NODES - 1}.0::DOUBLE - k) * (y2 - y), 0) AS y FROM {name}k, range({NODES}) t(i) WHERE m >= 15 AND floor(i * (m - 1) / {NODES - 1}.0::DOUBLE) = k)"""


def _fit_sql() -> str:
    """Two steps over explicit bases: the line by its closed form, the residual by a constant inverse."""
    import numpy as np

    _, b = L._bases(NODES, 3)
    inv = np.linalg.inv(b @ b.T)
    t = f"(i / {NODES - 1}.0::DOUBLE)"
    cols = ["1.0::DOUBLE"] + [f"{f}(2 * pi() * {h} * {t})" for h in (1, 2, 3) for f in ("sin", "cos")]
    basis = ", ".join(f"{c} AS b{k}" for k, c in enumerate(cols))
    sums = ", ".join(f"sum(r{c} * b{k}) AS {c}{k}" for c in "xy" for k in range(7))
    value = lambda c: f"max(l{c}) + " + " + ".join(f"b{r} * (" + " + ".join(f"{c}{k} * {float(inv[r, k])!r}::DOUBLE" for k in range(7)) + ")" for r in range(7))
    return f"""{with_('sk')}, w0 AS (SELECT frame_id, node_id, y FROM sk),
up AS (SELECT frame_id, node_id // 2 AS x, y FROM w0 WHERE node_id % 2 = 0), lo AS (SELECT frame_id, node_id // 2 AS x, y + 40.0::DOUBLE AS y FROM w0 WHERE node_id % 2 = 1),
{_interp('up', 'iu')}, {_interp('lo', 'il')}, mc AS (SELECT frame_id, i, (iu.x + il.x) / 2 AS x, (iu.y + il.y) / 2 AS y FROM iu JOIN il USING (frame_id, i)),
ln AS (SELECT frame_id, regr_slope(x, {t}) AS sx, regr_intercept(x, {t}) AS ox, regr_slope(y, {t}) AS sy, regr_intercept(y, {t}) AS oy FROM mc GROUP BY frame_id),
rs AS (SELECT mc.frame_id, i, ox + sx * {t} AS lx, oy + sy * {t} AS ly, x - ox - sx * {t} AS rx, y - oy - sy * {t} AS ry, {basis} FROM mc JOIN ln USING (frame_id)),
sm AS (SELECT frame_id, {sums} FROM rs GROUP BY frame_id)
SELECT frame_id, i, {s6(value('x').replace('max(lx)', 'lx'), 'x')}, {s6(value('y').replace('max(ly)', 'ly'), 'y')} FROM rs JOIN sm USING (frame_id)"""


def _centerline(s, d):
    u, lo = walls(s, d)
    return L.centerline(u, lo, NODES, width=60, height=120).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node_spacing") > 0).alias("spaced"), F.min((F.col("x_pixel") >= 0) & (F.col("y_pixel") <= 119)).alias("inside"))


def _directions(s, d):
    n = nodes(s, d).withColumnRenamed("node_id", "seq")
    return n, n.withColumn("x", F.col("x") + F.col("seq") % 7).where("seq % 5 <> 0")


DIR = f"{with_('sk')}, fw AS (SELECT frame_id, node_id AS seq, x, y FROM sk), bw AS (SELECT frame_id, node_id AS seq, x + node_id % 7 AS x, y FROM sk WHERE node_id % 5 <> 0)"


def _fields(s, d):
    f = field(s, d).select("frame_id", "x", "y", "p")
    return f.where("x % 2 = 0"), f.withColumn("p", 1.0 - F.col("p")).where("y % 3 = 0")


def _grown(s, d):
    """Areas grown from bright pixels to targets of 12 to 51 pixels, over pixels of middle brightness first."""
    t = tiles(s, d)
    target = table(s, d, "embeddings").select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 40 + 12).alias("area"))
    return G.grow_area(t.select("frame_id", "x", "y", (F.col("v") > 148).cast("int").alias("v")), t.select("frame_id", "x", "y", (F.col("v") / 255.0).alias("p")), target, SIDE, SIDE, least_p=0.5)


GROWN = f"""WITH RECURSIVE {with_('tile')[5:]}, st AS (SELECT frame_id, list(y * 8 + x) FILTER (WHERE v > 148) AS px, list(y * 8 + x) FILTER (WHERE v / 255.0::DOUBLE >= 0.5) AS ok, frame_id % 40 + 12 AS goal FROM tile GROUP BY frame_id),
run AS (
  SELECT frame_id, 0 AS i, coalesce(px, []) AS px, coalesce(ok, []) AS ok, goal FROM st
  UNION ALL
  SELECT frame_id, i + 1, list_concat(px, CASE WHEN len(list_intersect(fresh, ok)) > 0 THEN list_intersect(fresh, ok) ELSE fresh END), ok, goal
  FROM (SELECT *, list_filter(list_distinct(flatten(list_transform(px, lambda c: list_filter([CASE WHEN c % 8 < 7 THEN c + 1 ELSE -1 END, CASE WHEN c % 8 > 0 THEN c - 1 ELSE -1 END, c + 8, c - 8], lambda e: e BETWEEN 0 AND 63)))), lambda e: NOT list_contains(px, e)) AS fresh
        FROM run WHERE i < 25 AND len(px) < goal * 0.8::DOUBLE) WHERE len(fresh) > 0
), fin AS (SELECT frame_id, arg_max(px, i) AS px FROM run GROUP BY frame_id)
SELECT frame_id, x, y, CASE WHEN list_contains(px, y * 8 + x) THEN 255 ELSE 0 END AS v FROM tile JOIN fin USING (frame_id)"""

QUERIES = {
    "grow_area": (_grown, GROWN),
    "line_raster": (lambda s, d: G.raster_line(shape_points(s, d), 100, 100), f"WITH {SP}, {_raster('rl', False)} SELECT * FROM rl WHERE x >= 0 AND y >= 0"),
    "polygon_fill": (lambda s, d: G.fill_polygon(shape_points(s, d), SIDE, SIDE), f"{FILL} SELECT frame_id, x, y FROM fp"),
    "mode_hole_fill": _mode("hole_fill"),
    "mode_hole_crop": _mode("hole_crop"),
    "mode_object": _mode("object"),
    "mode_upper_left": _clip("upper_left"),
    "mode_lower_right": _clip("lower_right"),
    "search_line": (lambda s, d: r6(G.search_line(guide(s, d), field(s, d), "upper_left", REACH), "x", "y"), SEARCH_LINE),
    "search_contour": (lambda s, d: r6(G.search_contour(shape_points(s, d), field(s, d), REACH), "x", "y"), SEARCH_CONTOUR),
    "sk_fourier_fit": (_fit, _fit_sql()),
    "sk_centerline": (
        _centerline,
        f"{with_('sk')}, c AS (SELECT frame_id, count(*) FILTER (WHERE node_id % 2 = 0) AS u, count(*) FILTER (WHERE node_id % 2 = 1) AS l FROM sk GROUP BY frame_id) SELECT frame_id, {NODES} AS n, true AS spaced, true AS inside FROM c WHERE u >= 15 AND l >= 15",
    ),
    "fwd_bwd_blend": (
        lambda s, d: r6(G.blend_directions(*_directions(s, d)), "x", "y"),
        f"{DIR} SELECT frame_id, seq, {s6('coalesce((fw.x + bw.x) / 2, fw.x, bw.x)', 'x')}, {s6('coalesce((fw.y + bw.y) / 2, fw.y, bw.y)', 'y')} FROM fw FULL JOIN bw USING (frame_id, seq)",
    ),
    "field_max": (
        lambda s, d: r6(G.merge_fields(*_fields(s, d), gray=tiles(s, d)), "p"),
        f"{with_('tile')} SELECT frame_id, x, y, {s6('coalesce(greatest(CASE WHEN x % 2 = 0 THEN v / 255.0::DOUBLE END, CASE WHEN y % 3 = 0 THEN 1.0 - v / 255.0::DOUBLE END), (255 - v) / 255.0::DOUBLE)', 'p')} FROM tile",
    ),
    "line_shift": (
        lambda s, d: r6(G.displacement(*_directions(s, d)), "max_shift", "mean_shift"),
        f"{DIR} SELECT frame_id, {s6('max(abs(fw.x - bw.x))', 'max_shift')}, {s6('avg(abs(fw.x - bw.x))', 'mean_shift')} FROM fw JOIN bw USING (frame_id, seq) GROUP BY frame_id",
    ),
    "median_shift": (
        lambda s, d: r6(G.median_shift(nodes(s, d).select("frame_id", F.col("x").alias("dx"), F.col("y").alias("dy"), ((F.col("node_id") % 3 == 0) & (F.col("frame_id") % 2 == 0)).alias("good"))), "dx", "dy"),
        f"{with_('sk')} SELECT frame_id, {s6('median(x)', 'dx')}, {s6('median(y)', 'dy')} FROM sk WHERE frame_id % 2 = 1 OR node_id % 3 = 0 GROUP BY frame_id",
    ),
    "coherent_smooth": (
        lambda s, d: r6(G.coherent(nodes(s, d).withColumnRenamed("node_id", "seq"), nodes(s, d).withColumnRenamed("node_id", "seq").withColumn("x", F.col("x") + F.when(F.col("frame_id") % 4 == 0, 50.0).otherwise(1.0))), "x", "y"),
        f"{with_('sk')} SELECT frame_id, node_id AS seq, {s6('x + CASE WHEN frame_id % 4 = 0 THEN 0.0 ELSE 1.0 END', 'x')}, {s6('y', 'y')} FROM sk",
    ),
    "tracked_box": (
        lambda s, d: G.tracked_box(nodes(s, d), 90, 90).select("frame_id", *[F.col(c).cast("long").alias(c) for c in ("ymin", "ymax", "xmin", "xmax")]),
        f"{with_('sk')} SELECT frame_id, CAST(greatest(floor(min(y)) - 20, 0) AS BIGINT) AS ymin, CAST(least(ceil(max(y)) + 20, 90) AS BIGINT) AS ymax, CAST(greatest(floor(min(x)), 0) AS BIGINT) AS xmin, CAST(least(ceil(max(x)) + 1, 90) AS BIGINT) AS xmax FROM sk GROUP BY frame_id",
    ),
    "boundary_bands": (
        lambda s, d: G.boundary_bands(mask(s, d), SIDE, SIDE, 1, least=3),
        f"""{with_('tile')}, {M}, dd AS (SELECT a.frame_id, a.x, a.y, a.v, coalesce(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FILTER (WHERE b.v > 0), 1000) AS fg, coalesce(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FILTER (WHERE b.v = 0), 1000) AS bg FROM m0 a JOIN m0 b USING (frame_id) GROUP BY ALL),
rg AS (SELECT *, fg <= 1 AND NOT (v > 0 AND bg > 1) AS ring FROM dd), sz AS (SELECT *, count(*) FILTER (WHERE ring) OVER (PARTITION BY frame_id) AS n FROM rg),
lb AS (SELECT frame_id, x, y, CASE WHEN CASE WHEN n >= 3 THEN ring ELSE fg <= 1 AND v = 0 END THEN 1 WHEN (v > 0 AND bg > 16) OR fg > 49 THEN 0 END AS label FROM sz)
SELECT frame_id, x, y, CAST(label AS INT) AS label FROM lb WHERE label IS NOT NULL""",
    ),
}
