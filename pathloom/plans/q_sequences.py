"""Queries on polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import sequences as S
from pathloom.plans.adapters import nodes, with_

#: Points of a resampled line in these queries.
N = 32
W = "(PARTITION BY frame_id ORDER BY node_id)"
ALL = "(PARTITION BY frame_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to 6 decimals, without negative zeros."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def s6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _tap(c: str, k: int, window: str, edges: str) -> str:
    if k == 0:
        return c
    f, e, n = ("lag", "first_value", -k) if k < 0 else ("lead", "last_value", k)
    return f"coalesce({f}({c}, {n}) OVER {window}, {e}({c}) OVER {edges})"


def taps(c: str, sigma: float, window: str, edges: str) -> str:
    w = S.gauss(sigma)
    r = len(w) // 2
    return " + ".join(f"{_tap(c, k - r, window, edges)} * {w[k]!r}::DOUBLE" for k in range(2 * r + 1))


def _resample_sql(closed: bool) -> str:
    to = lambda c: f"coalesce(lead({c}) OVER {W}, first_value({c}) OVER {ALL})" if closed else f"lead({c}) OVER {W}"
    parts = N if closed else N - 1
    return f"""{with_("sk")},
s AS (SELECT frame_id, node_id, x, y, {to("x")} AS x2, {to("y")} AS y2 FROM sk),
g AS (SELECT *, coalesce(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0.0) AS seg FROM s),
c AS (SELECT *, sum(seg) OVER (PARTITION BY frame_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, sum(seg) OVER (PARTITION BY frame_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM g),
d AS (SELECT *, b - seg AS a FROM c WHERE seg > 0),
p AS (SELECT d.*, i, i * total / {parts} AS pos FROM d, range({N}) t(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY frame_id, i ORDER BY node_id) AS rk FROM p
  WHERE (pos >= a OR a = (SELECT min(q.a) FROM d q WHERE q.frame_id = p.frame_id)) AND (pos < b OR b = (SELECT max(q.b) FROM d q WHERE q.frame_id = p.frame_id)))
SELECT frame_id, i, {s6("x + least(greatest((pos - a) / seg, 0.0), 1.0) * (x2 - x)", "x")}, {s6("y + least(greatest((pos - a) / seg, 0.0), 1.0) * (y2 - y)", "y")} FROM f WHERE rk = 1"""


def _mirrored_sql(c: str, sigma: float) -> str:
    w = S.gauss(sigma)
    r = len(w) // 2
    m = lambda k: f"((k + {k}) % (2 * n) + 2 * n) % (2 * n)"
    return " + ".join(f"{c}s[least({m(j - r)}, 2 * n - 1 - {m(j - r)}) + 1] * {w[j]!r}::DOUBLE" for j in range(2 * r + 1))


def _laplacian_sql(passes: int) -> str:
    steps, source = [], "sk"
    for k in range(passes):
        near = lambda c: f"(coalesce(lag({c}) OVER {W}, last_value({c}) OVER {ALL}) + coalesce(lead({c}) OVER {W}, first_value({c}) OVER {ALL})) / 2"
        steps.append(f"l{k} AS (SELECT frame_id, node_id, x + 0.5::DOUBLE * ({near('x')} - x) AS x, y + 0.5::DOUBLE * ({near('y')} - y) AS y FROM {source})")
        source = f"l{k}"
    return f"{with_('sk')}, {', '.join(steps)} SELECT frame_id, node_id, x, y FROM {source}"


def _normals_sql(closed: bool) -> str:
    ends = lambda c: (f"last_value({c}) OVER {ALL}", f"first_value({c}) OVER {ALL}") if closed else (c, c)
    d = lambda c: f"coalesce(lead({c}) OVER {W}, {ends(c)[1]}) - coalesce(lag({c}) OVER {W}, {ends(c)[0]})"
    turn = "ux * (x - mx) + uy * (y - my) < 0" if closed else "uy < 0"
    return f"""{with_("sk")},
t AS (SELECT frame_id, node_id, x, y, {d("x")} AS tx, {d("y")} AS ty, avg(x) OVER (PARTITION BY frame_id) AS mx, avg(y) OVER (PARTITION BY frame_id) AS my FROM sk),
u AS (SELECT *, CASE WHEN tx * tx + ty * ty > 0 THEN ty / sqrt(tx * tx + ty * ty) ELSE 0 END AS ux, -(CASE WHEN tx * tx + ty * ty > 0 THEN tx / sqrt(tx * tx + ty * ty) ELSE 0 END) AS uy FROM t)
SELECT frame_id, node_id, {s6(f"CASE WHEN {turn} THEN -ux ELSE ux END", "nx")}, {s6(f"CASE WHEN {turn} THEN -uy ELSE uy END", "ny")} FROM u"""


AXIS = "a AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle, count(*) AS n FROM sk GROUP BY frame_id)"
DAMP = f"""{AXIS},
d0 AS (SELECT sk.frame_id, node_id, x, y, cx, cy, n, cos(angle) AS ux, sin(angle) AS uy FROM sk JOIN a USING (frame_id)),
d1 AS (SELECT *, (x - cx) * ux + (y - cy) * uy AS al FROM d0),
d2 AS (SELECT *, x - cx - al * ux AS px, y - cy - al * uy AS py FROM d1),
d3 AS (SELECT *, sqrt(px * px + py * py) AS d FROM d2),
dm AS (SELECT frame_id, node_id, n, CASE WHEN n >= 5 AND d > 0.01 THEN cx + al * ux + 3 * tanh(d / 3) / d * px ELSE x END AS x,
  CASE WHEN n >= 5 AND d > 0.01 THEN cy + al * uy + 3 * tanh(d / 3) / d * py ELSE y END AS y FROM d3)"""
BY_NODE, BY_NODE_ALL = "(PARTITION BY node_id ORDER BY frame_id)", "(PARTITION BY node_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _frames_sql(source: str, c: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY node_id) > 3 THEN {taps(c, 1.5, BY_NODE, BY_NODE_ALL)} ELSE {c} END"


def _tips(spark, sf):
    return r6(S.tips(nodes(spark, sf), 101, 101), "start_x", "start_y", "end_x", "end_y")


def _ray(p: str, q: str, u: str, v: str) -> str:
    ways = ", ".join(f"CASE WHEN {d} <> 0 AND ({e} - {at}) / {d} > 1e-5 THEN ({e} - {at}) / {d} END" for at, d in ((p, u), (q, v)) for e in ("0.0::DOUBLE", "100.0::DOUBLE"))
    return f"least({ways})"


def _inside(p: str, way: str) -> str:
    return f"CASE WHEN {way} IS NULL THEN {p} ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, {p} + {way})) END"


QUERIES = {
    "sk_segments": (
        lambda s, d: r6(S.segments(nodes(s, d)).select("frame_id", "node_id", "dx", "dy", "seg"), "dx", "dy", "seg"),
        f"{with_('sk')}, l AS (SELECT frame_id, node_id, lead(x) OVER {W} - x AS dx, lead(y) OVER {W} - y AS dy FROM sk) SELECT frame_id, node_id, {s6('dx', 'dx')}, {s6('dy', 'dy')}, {s6('sqrt(dx * dx + dy * dy)', 'seg')} FROM l",
    ),
    "sk_arclength": (
        lambda s, d: r6(S.arc_length(nodes(s, d)).select("frame_id", "node_id", "cum"), "cum"),
        f"{with_('sk')}, l AS (SELECT frame_id, node_id, x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy FROM sk) SELECT frame_id, node_id, {s6(f'sum(coalesce(sqrt(dx * dx + dy * dy), 0.0)) OVER {W}', 'cum')} FROM l",
    ),
    "sk_mean_spacing": (
        lambda s, d: r6(S.mean_spacing(nodes(s, d)), "spacing"),
        f"{with_('sk')}, l AS (SELECT frame_id, lead(x) OVER {W} - x AS dx, lead(y) OVER {W} - y AS dy FROM sk) SELECT frame_id, {s6('avg(sqrt(dx * dx + dy * dy))', 'spacing')} FROM l GROUP BY frame_id",
    ),
    "sk_resample_open": (lambda s, d: r6(S.resample_open(nodes(s, d), N), "x", "y"), _resample_sql(False)),
    "sk_resample_closed": (lambda s, d: r6(S.resample_closed(nodes(s, d), N), "x", "y"), _resample_sql(True)),
    "sk_interp_index": (
        lambda s, d: r6(S.interpolate_index(nodes(s, d), N), "x", "y"),
        f"""{with_('sk')}, c AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS m, lead(x) OVER {W} AS x2, lead(y) OVER {W} AS y2 FROM sk),
p AS (SELECT c.*, i, i * (m - 1) / {N - 1}::DOUBLE AS pos FROM c, range({N}) t(i))
SELECT frame_id, i, {s6('x + coalesce((pos - node_id) * (x2 - x), 0)', 'x')}, {s6('y + coalesce((pos - node_id) * (y2 - y), 0)', 'y')} FROM p WHERE floor(pos) = node_id""",
    ),
    "sk_gauss_node": (
        lambda s, d: S.smooth(nodes(s, d), ["x", "y"], 1.2).select("frame_id", "node_id", "x", "y"),
        f"{with_('sk')} SELECT frame_id, node_id, {taps('x', 1.2, W, ALL)} AS x, {taps('y', 1.2, W, ALL)} AS y FROM sk",
    ),
    "sk_gauss_frame": (
        lambda s, d: S.smooth_frames(nodes(s, d), ["x", "y"]).select("frame_id", "node_id", "x", "y"),
        f"{with_('sk')} SELECT frame_id, node_id, {_frames_sql('sk', 'x')} AS x, {_frames_sql('sk', 'y')} AS y FROM sk",
    ),
    "sk_gauss_reflect": (
        lambda s, d: S.smooth(nodes(s, d), ["x", "y"], 1.0, edge="reflect").select("frame_id", "node_id", "x", "y"),
        f"{with_('sk')}, l AS (SELECT frame_id, node_id, node_id AS k, count(*) OVER (PARTITION BY frame_id) AS n, list(x) OVER {ALL} AS xs, list(y) OVER {ALL} AS ys FROM sk) SELECT frame_id, node_id, {_mirrored_sql('x', 1.0)} AS x, {_mirrored_sql('y', 1.0)} AS y FROM l",
    ),
    "sk_moving_avg": (
        lambda s, d: S.moving_average(nodes(s, d)).select("frame_id", "node_id", "y"),
        f"{with_('sk')} SELECT frame_id, node_id, CASE WHEN lag(y) OVER {W} IS NULL OR lead(y) OVER {W} IS NULL THEN y ELSE (lag(y) OVER {W} + y + lead(y) OVER {W}) / 3 END AS y FROM sk",
    ),
    "sk_laplacian": (lambda s, d: S.laplacian(nodes(s, d)).select("frame_id", "node_id", "x", "y"), _laplacian_sql(3)),
    "sk_normals": (lambda s, d: r6(S.normals(nodes(s, d)).select("frame_id", "node_id", "nx", "ny"), "nx", "ny"), _normals_sql(False)),
    "sk_normals_closed": (lambda s, d: r6(S.normals(nodes(s, d), closed=True).select("frame_id", "node_id", "nx", "ny"), "nx", "ny"), _normals_sql(True)),
    "sk_pca_axis": (
        lambda s, d: r6(S.principal_axis(nodes(s, d)), "cx", "cy", "angle"),
        f"{with_('sk')}, {AXIS} SELECT frame_id, {s6('cx', 'cx')}, {s6('cy', 'cy')}, {s6('angle', 'angle')} FROM a",
    ),
    "sk_tanh_damp": (
        lambda s, d: r6(S.damp(nodes(s, d)).select("frame_id", "node_id", "x", "y"), "x", "y"),
        f"{with_('sk')}, {DAMP} SELECT frame_id, node_id, {s6('x', 'x')}, {s6('y', 'y')} FROM dm",
    ),
    "sk_refine_full": (
        lambda s, d: r6(S.refine(nodes(s, d)).select("frame_id", "node_id", "x", "y"), "x", "y"),
        f"""{with_('sk')}, {DAMP},
sm AS (SELECT frame_id, node_id, CASE WHEN n >= 5 THEN {taps('x', 1.2, W, ALL)} ELSE x END AS x, CASE WHEN n >= 5 THEN {taps('y', 1.2, W, ALL)} ELSE y END AS y FROM dm)
SELECT frame_id, node_id, {s6(_frames_sql('sm', 'x'), 'x')}, {s6(_frames_sql('sm', 'y'), 'y')} FROM sm""",
    ),
    "sk_line_bbox": (
        lambda s, d: S.padded_box(nodes(s, d), 20, 100, 100),
        f"{with_('sk')} SELECT frame_id, greatest(CAST(floor(min(y)) AS BIGINT) - 20, 0) AS ymin, least(CAST(ceil(max(y)) AS BIGINT) + 21, 100) AS ymax, greatest(CAST(floor(min(x)) AS BIGINT) - 20, 0) AS xmin, least(CAST(ceil(max(x)) AS BIGINT) + 21, 100) AS xmax FROM sk GROUP BY frame_id",
    ),
    "sk_tip_extend": (
        _tips,
        f"""{with_('sk')}, {AXIS},
e AS (SELECT frame_id, arg_min(x, node_id) AS ax, arg_min(y, node_id) AS ay, arg_max(x, node_id) AS bx, arg_max(y, node_id) AS by_ FROM sk GROUP BY frame_id),
u AS (SELECT e.*, CASE WHEN (bx - ax) * cos(angle) + (by_ - ay) * sin(angle) < 0 THEN -1 ELSE 1 END * cos(angle) AS ux, CASE WHEN (bx - ax) * cos(angle) + (by_ - ay) * sin(angle) < 0 THEN -1 ELSE 1 END * sin(angle) AS uy FROM e JOIN a USING (frame_id)),
t AS (SELECT *, {_ray('ax', 'ay', '-ux', '-uy')} AS ta, {_ray('bx', 'by_', 'ux', 'uy')} AS tb FROM u)
SELECT frame_id, {s6(_inside('ax', '-ta * ux'), 'start_x')}, {s6(_inside('ay', '-ta * uy'), 'start_y')}, {s6(_inside('bx', 'tb * ux'), 'end_x')}, {s6(_inside('by_', 'tb * uy'), 'end_y')} FROM t""",
    ),
    "sk_ema": (
        lambda s, d: r6(S.ema(S.interpolate_index(nodes(s, d), N).withColumnRenamed("i", "node_id").withColumn("layer_id", F.col("frame_id") % 10), base=0.55).select("layer_id", "frame_id", "node_id", "x", "y"), "x", "y"),
        f"""WITH RECURSIVE {with_('sk')[5:]}, c AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS m, lead(x) OVER {W} AS x2, lead(y) OVER {W} AS y2 FROM sk),
p AS (SELECT c.*, i, i * (m - 1) / {N - 1}::DOUBLE AS pos FROM c, range({N}) t(i)),
e AS (SELECT frame_id, i AS node_id, x + coalesce((pos - node_id) * (x2 - x), 0) AS x, y + coalesce((pos - node_id) * (y2 - y), 0) AS y FROM p WHERE floor(pos) = node_id),
l AS (SELECT frame_id, frame_id % 10 AS layer_id, list(x ORDER BY node_id) AS xs, list(y ORDER BY node_id) AS ys, row_number() OVER (PARTITION BY frame_id % 10 ORDER BY frame_id) AS k FROM e GROUP BY frame_id),
run AS (
  SELECT layer_id, k, frame_id, xs, ys FROM l WHERE k = 1
  UNION ALL
  SELECT l.layer_id, l.k, l.frame_id, list_transform(range(1, len(l.xs) + 1), lambda i: a * l.xs[i] + (1 - a) * q.xs[i]), list_transform(range(1, len(l.xs) + 1), lambda i: a * l.ys[i] + (1 - a) * q.ys[i])
  FROM (SELECT r.layer_id, r.k, r.xs, r.ys, least(0.65::DOUBLE, greatest(0.40::DOUBLE, 0.55::DOUBLE - list_avg(list_transform(range(1, len(r.xs) + 1), lambda i: sqrt((n.xs[i] - r.xs[i]) * (n.xs[i] - r.xs[i]) + (n.ys[i] - r.ys[i]) * (n.ys[i] - r.ys[i])))) / 30)) AS a
        FROM run r JOIN l n ON n.layer_id = r.layer_id AND n.k = r.k + 1) q JOIN l ON l.layer_id = q.layer_id AND l.k = q.k + 1
)
SELECT layer_id, frame_id, unnest(range(len(xs))) AS node_id, round(unnest(xs), 6) + 0.0 AS x, round(unnest(ys), 6) + 0.0 AS y FROM run""",
    ),
}
