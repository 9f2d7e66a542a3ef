"""Queries on trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import trajectory as T
from pathloom.plans.adapters import nodes, track, with_
from pathloom.plans.q_sequences import W, r6, s6

SPECIAL = (50.0, 50.0)


def com(s, d, kind: str):
    """Centres of mass: of the 'view' nodes of a frame (particle) or of its 'click' nodes (landmark)."""
    return nodes(s, d).where(F.col("event_type") == kind).groupBy("frame_id").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))


def _full(s, d):
    n = nodes(s, d)
    pm, fm = com(s, d, "view"), com(s, d, "click")
    first = pm.join(fm, "frame_id", "left_semi").agg(F.min("frame_id")).first()[0]
    return r6(T.trajectory(n, pm, fm, first, SPECIAL), "Longitudinal_From_Special", "Transverse_Dist", "Special_Node_X", "Special_Node_Y")


COM = "pm AS (SELECT frame_id, avg(x) AS tx, avg(y) AS ty FROM sk WHERE event_type = 'view' GROUP BY frame_id), fm AS (SELECT frame_id, avg(x) AS tx, avg(y) AS ty FROM sk WHERE event_type = 'click' GROUP BY frame_id)"
SEG = f"sg AS (SELECT frame_id, node_id, x, y, lead(x) OVER {W} AS x2, lead(y) OVER {W} AS y2 FROM sk)"


def anchor_sql(name: str, target: str) -> str:
    return f"""{name}d AS (SELECT sg.*, tx, ty, (tx - x) * (tx - x) + (ty - y) * (ty - y) AS d2 FROM sg JOIN {target} USING (frame_id)),
{name}n AS (SELECT frame_id, min(d2) AS m, arg_min(node_id, (d2, node_id)) AS cn, arg_min(x, (d2, node_id)) AS nx, arg_min(y, (d2, node_id)) AS ny FROM {name}d GROUP BY frame_id),
{name}t AS (SELECT d.*, m, least(greatest(((tx - x) * (x2 - x) + (ty - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0.0), 1.0) AS t FROM {name}d d JOIN {name}n USING (frame_id) WHERE node_id BETWEEN cn - 1 AND cn AND (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) > 0),
{name}p AS (SELECT *, x + t * (x2 - x) AS px, y + t * (y2 - y) AS py FROM {name}t),
{name}q AS (SELECT *, (tx - px) * (tx - px) + (ty - py) * (ty - py) AS dd FROM {name}p),
{name}k AS (SELECT frame_id, arg_min(px, (dd, node_id)) AS px, arg_min(py, (dd, node_id)) AS py, arg_min(node_id + t, (dd, node_id)) AS f FROM {name}q WHERE dd < m GROUP BY frame_id),
{name} AS (SELECT frame_id, coalesce(px, nx) AS ax, coalesce(py, ny) AS ay, coalesce(f, CAST(cn AS DOUBLE)) AS frac, m AS d2, ny FROM {name}n LEFT JOIN {name}k USING (frame_id))"""


FULL = f"""{with_("sk")}, {COM}, {SEG}, {anchor_sql("fa", "fm")}, {anchor_sql("pa", "pm")},
ub AS (SELECT frame_id, ax, ay, CASE WHEN g > 0 THEN (tx - ax) / g ELSE 1 END AS ux, CASE WHEN g > 0 THEN (ty - ay) / g ELSE 0 END AS uy FROM (SELECT *, sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)) AS g FROM fa JOIN fm USING (frame_id))),
cal AS (SELECT (50 - ax) * ux + (50 - ay) * uy AS cx, -(50 - ax) * uy + (50 - ay) * ux AS cy FROM ub WHERE frame_id = (SELECT min(frame_id) FROM pm JOIN fm USING (frame_id))),
sp AS (SELECT frame_id, ax + cx * ux - cy * uy AS tx, ay + cx * uy + cy * ux AS ty FROM ub, cal), {anchor_sql("sa", "sp")},
z AS (SELECT frame_id, max(node_id) AS last FROM sk GROUP BY frame_id),
ms AS (SELECT frame_id, avg(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS spacing FROM sg GROUP BY frame_id)
SELECT frame_id AS "Frame", {s6("(pa.frac - least(greatest(round_even(sa.frac, 0), 0), last)) * spacing", '"Longitudinal_From_Special"')},
  {s6("CASE WHEN pm.ty <= pa.ny THEN sqrt(pa.d2) ELSE -sqrt(pa.d2) END", '"Transverse_Dist"')}, {s6("sp.tx", '"Special_Node_X"')}, {s6("sp.ty", '"Special_Node_Y"')}
FROM pa JOIN sa USING (frame_id) JOIN pm USING (frame_id) JOIN sp USING (frame_id) JOIN z USING (frame_id) JOIN ms USING (frame_id)"""

PEAKS = f"""{with_("tr")},
v AS (SELECT track, "Frame" AS i, "Longitudinal" AS v, max("Frame") OVER (PARTITION BY track) AS n FROM tr),
g AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY track ORDER BY i) THEN 0 ELSE 1 END AS s FROM v),
h AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY i) AS run FROM g),
r AS (SELECT track, run, min(i) AS a, max(i) AS b, any_value(v) AS v, any_value(n) AS n FROM h GROUP BY track, run),
e AS (SELECT *, lag(v) OVER (PARTITION BY track ORDER BY run) AS before, lead(v) OVER (PARTITION BY track ORDER BY run) AS after FROM r),
p AS (SELECT track, (a + b) // 2 AS i, v FROM e WHERE before < v AND after < v),
q AS (SELECT p.*, coalesce((SELECT max(i) FROM v x WHERE x.track = p.track AND x.i < p.i AND x.v > p.v), -1) AS l, coalesce((SELECT min(i) FROM v x WHERE x.track = p.track AND x.i > p.i AND x.v > p.v), 1000000) AS r FROM p),
k AS (SELECT q.track, q.i, q.v, q.v - greatest((SELECT min(x.v) FROM v x WHERE x.track = q.track AND x.i > q.l AND x.i <= q.i), (SELECT min(x.v) FROM v x WHERE x.track = q.track AND x.i >= q.i AND x.i < q.r)) AS prom FROM q),
o AS (SELECT * FROM k WHERE prom >= 0.1::DOUBLE),
t AS (SELECT DISTINCT track FROM v)
SELECT track, coalesce(min(o.i) FILTER (WHERE o.v > 0), min(o.i)) AS first_peak, coalesce(max(o.i) FILTER (WHERE o.v > 0), max(o.i)) AS last_peak, count(o.i) AS n_peaks FROM t LEFT JOIN o USING (track) GROUP BY track"""


def _inversion(s, d):
    return s.range(10).select(F.col("id").alias("track"), (F.col("id") % 2 == 0).alias("invert"))


QUERIES = {
    "traj_full": (_full, FULL),
    "traj_com": (lambda s, d: r6(com(s, d, "view"), "tx", "ty"), f"{with_('sk')}, {COM} SELECT frame_id, {s6('tx', 'tx')}, {s6('ty', 'ty')} FROM pm"),
    "traj_nearest": (
        lambda s, d: r6(T.nearest_node(nodes(s, d), com(s, d, "view")), "d2").select("frame_id", "node_id", "d2"),
        f"{with_('sk')}, {COM}, {SEG}, {anchor_sql('pa', 'pm')} SELECT frame_id, cn AS node_id, {s6('m', 'd2')} FROM pan",
    ),
    "traj_anchor": (
        lambda s, d: r6(T.anchor(nodes(s, d), com(s, d, "view")), "ax", "ay", "frac"),
        f"{with_('sk')}, {COM}, {SEG}, {anchor_sql('pa', 'pm')} SELECT frame_id, {s6('ax', 'ax')}, {s6('ay', 'ay')}, {s6('frac', 'frac')} FROM pa",
    ),
    "traj_units": (
        lambda s, d: r6(T.convert_units(track(s, d), _inversion(s, d)), "time_s", "longitudinal_um", "transverse_um").select("track", "Frame", "time_s", "longitudinal_um", "transverse_um"),
        f"{with_('tr')}, inv AS (SELECT i AS track, i % 2 = 0 AS invert FROM range(10) t(i)) SELECT track, \"Frame\", {s6('\"Frame\" / 249.2::DOUBLE', 'time_s')}, {s6('\"Longitudinal\" * 0.04::DOUBLE * CASE WHEN coalesce(invert, true) THEN -1 ELSE 1 END', 'longitudinal_um')}, {s6('\"Transverse\" * 0.04::DOUBLE', 'transverse_um')} FROM tr LEFT JOIN inv USING (track)",
    ),
    "traj_ends": (
        lambda s, d: T.ends(track(s, d)),
        f"{with_('tr')} SELECT track, arg_min(\"Longitudinal\", \"Frame\") AS first_longitudinal, arg_min(\"Transverse\", \"Frame\") AS first_transverse, arg_max(\"Longitudinal\", \"Frame\") AS last_longitudinal, arg_max(\"Transverse\", \"Frame\") AS last_transverse, min(\"Frame\") AS first_frame, max(\"Frame\") AS last_frame FROM tr GROUP BY track",
    ),
    "traj_peaks": (lambda s, d: T.peaks(track(s, d)), PEAKS),
}
