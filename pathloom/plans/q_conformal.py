"""Queries on uncertainty: conformal p-values, forest weights, fields and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import conformal as C
from pathloom.operators.ranking import lower_percentiles
from pathloom.plans.adapters import samples, table, with_
from pathloom.plans.q_sequences import r6, s6

TAU = 0.5
FORESTS = 4


def drawn():
    """A hash that both engines have, as 40 bits, to draw samples by."""
    text = F.concat(F.lit("draw "), F.col("sample_id").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def scores(s, d):
    """Four forests' scores of each labelled sample: linear forms of one score."""
    f = F.explode(F.sequence(F.lit(0), F.lit(FORESTS - 1))).alias("forest")
    return samples(s, d).select("sample_id", "label", "score", "part", f).select(
        "forest", "sample_id", "label", "part", (F.col("score") * (4 - F.col("forest")) / 4.0 + F.col("forest") / 16.0).alias("p1"),
    ).withColumn("p0", 1.0 - F.col("p1"))


def _long(s, d):
    return C.long_scores(scores(s, d), "label", "part")


def _p(s, d, part: int):
    df = _long(s, d)
    return C.p_values(df.where(F.col("part") == part), df.where("part = 0"), TAU)


def _cdum(s, d):
    wide = _p(s, d, 1).groupBy("forest", "sample_id", "label").agg(F.max(F.when(F.col("y") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("y") == 1, F.col("p"))).alias("p1"))
    return C.cdum(wide)


def _field(s, d):
    p = C.aggregate_forests(_p(s, d, 2), C.weights(_cdum(s, d))).where("y = 1")
    return C.probability_field(p.withColumn("batch", F.col("sample_id") % 10), ["batch"])


LONG = f"""{with_('smp')}, sc AS (SELECT f AS forest, sample_id, label, part, score * (4 - f) / 4.0::DOUBLE + f / 16.0::DOUBLE AS p1 FROM smp, range({FORESTS}) t(f)),
lg AS (SELECT forest, sample_id, label, part, y, CASE WHEN y = 1 THEN (1.0::DOUBLE + p1 - (1.0::DOUBLE - p1)) / 2.0::DOUBLE ELSE (1.0::DOUBLE + (1.0::DOUBLE - p1) - p1) / 2.0::DOUBLE END AS score FROM sc, range(2) t(y)),
cal AS (SELECT forest, y, score FROM lg WHERE part = 0 AND label = y),
pv AS (SELECT lg.forest, sample_id, label, part, lg.y, lg.score, coalesce((count(cal.score) FILTER (WHERE cal.score < lg.score) + {TAU}::DOUBLE * count(cal.score) FILTER (WHERE cal.score = lg.score)) / (nullif(count(cal.score), 0) + 1.0::DOUBLE), 0.0::DOUBLE) AS p
  FROM lg LEFT JOIN cal ON cal.forest = lg.forest AND cal.y = lg.y WHERE part > 0 GROUP BY ALL)"""
CDUM = f"""{LONG},
wide AS (SELECT forest, sample_id, label, max(p) FILTER (WHERE y = 0) AS p0, max(p) FILTER (WHERE y = 1) AS p1 FROM pv WHERE part = 1 GROUP BY ALL),
st AS (SELECT forest, label, CAST(p0 > 0.05::DOUBLE AS INT) AS s0, CAST(p1 > 0.05::DOUBLE AS INT) AS s1 FROM wide),
cu AS (SELECT forest, y, 0.9::DOUBLE * coalesce(avg(CASE WHEN s0 + s1 > 0 THEN s0 + s1 - CASE WHEN y = 1 THEN s1 ELSE s0 END ELSE 1 END) FILTER (WHERE label = y), 1.0) + (1.0::DOUBLE - 0.9::DOUBLE) * coalesce(avg(CASE WHEN y = 1 THEN s1 ELSE s0 END) FILTER (WHERE label <> y), 1.0) AS u FROM st, range(2) t(y) GROUP BY forest, y)"""
WEIGHTS = f"""{CDUM},
rw AS (SELECT *, greatest((1.0 - u) / (1.0 + u + 1e-8::DOUBLE), 0.0) AS w FROM cu),
wt AS (SELECT forest, y, u, CASE WHEN sum(w) OVER (PARTITION BY y) > 0 THEN w / sum(w) OVER (PARTITION BY y) ELSE 1.0 / count(*) OVER (PARTITION BY y) END AS weight FROM rw)"""

RANKED = f"{with_('smp')}, rk AS (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('draw ' || sample_id), 1, 10) AS BIGINT), sample_id) AS k, count(*) OVER (PARTITION BY label) AS c FROM smp)"

QUERIES = {
    "conf_score": (lambda s, d: r6(_long(s, d), "score").select("forest", "sample_id", F.col("y").cast("long").alias("y"), "score"), f"{LONG} SELECT forest, sample_id, y, {s6('score', 'score')} FROM lg"),
    "conf_pvalue": (lambda s, d: r6(_p(s, d, 2), "p").select("forest", "sample_id", F.col("y").cast("long").alias("y"), "p"), f"{LONG} SELECT forest, sample_id, y, {s6('p', 'p')} FROM pv WHERE part = 2"),
    "conf_untrained": (lambda s, d: C.untrained_p_values(_long(s, d)).select("forest", "sample_id", "p"), f"{LONG} SELECT forest, sample_id, 0.5::DOUBLE AS p FROM lg"),
    "conf_set": (
        lambda s, d: _p(s, d, 2).groupBy("forest").agg(F.count_if(C.prediction_set(F.col("p"))).alias("members"), F.count(F.lit(1)).alias("n")),
        f"{LONG} SELECT forest, count(*) FILTER (WHERE p > 0.05::DOUBLE) AS members, count(*) AS n FROM pv WHERE part = 2 GROUP BY forest",
    ),
    "conf_cdum": (lambda s, d: r6(_cdum(s, d), "u").select("forest", F.col("y").cast("long").alias("y"), "u"), f"{CDUM} SELECT forest, y, {s6('u', 'u')} FROM cu"),
    "conf_weights": (lambda s, d: r6(C.weights(_cdum(s, d)), "weight").select("forest", F.col("y").cast("long").alias("y"), "weight"), f"{WEIGHTS} SELECT forest, y, {s6('weight', 'weight')} FROM wt"),
    "conf_filter": (
        lambda s, d: r6(C.normalised(_cdum(s, d), 0.5), "norm", "threshold").select("forest", F.col("y").cast("long").alias("y"), "norm", "threshold", "filtered"),
        f"""{CDUM}, nm AS (SELECT forest, y, u / (sum(u) OVER (PARTITION BY y) + 1e-8::DOUBLE) AS norm FROM cu),
ls AS (SELECT y, list_sort(list(norm)) AS l FROM nm GROUP BY y), th AS (SELECT y, l[CAST(floor(least(ceil((len(l) + 1) * 0.5::DOUBLE) / len(l), 1.0) * (len(l) - 1)) AS BIGINT) + 1] AS threshold FROM ls)
SELECT forest, y, {s6('norm', 'norm')}, {s6('threshold', 'threshold')}, norm > threshold AS filtered FROM nm JOIN th USING (y)""",
    ),
    "conf_lower_pct": (
        lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(C.lower_percentile(F.col("n_nationkey"), 0.6).alias("p60")),
        "SELECT n_regionkey, l[CAST(floor(0.6::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS p60 FROM (SELECT n_regionkey, list_sort(list(n_nationkey)) AS l FROM nation GROUP BY n_regionkey)",
    ),
    "conf_lower_pct_large": (
        lambda s, d: lower_percentiles(table(s, d, "events"), ["event_type"], "value", 0.9),
        "SELECT event_type, l[CAST(floor(0.9::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS value FROM (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    ),
    "conf_field": (
        lambda s, d: r6(_field(s, d), "field").select("sample_id", "field"),
        f"""{WEIGHTS}, ag AS (SELECT sample_id, sum(p * weight) AS p FROM pv JOIN wt ON pv.forest = wt.forest AND pv.y = wt.y WHERE part = 2 AND pv.y = 1 GROUP BY sample_id),
fr AS (SELECT sample_id, p * CASE WHEN p > 0.05::DOUBLE THEN 1.0 ELSE 0.7 END AS r, sample_id % 10 AS b FROM ag)
SELECT sample_id, {s6('CASE WHEN max(r) OVER (PARTITION BY b) > 0 THEN r / max(r) OVER (PARTITION BY b) ELSE r END', 'field')} FROM fr""",
    ),
    "auc_ranksum": (
        lambda s, d: r6(C.auc(samples(s, d).withColumn("g", F.col("part")), ["g"]), "auc"),
        f"""{with_('smp')}, pr AS (SELECT a.part AS g, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS t FROM smp a JOIN smp b ON a.part = b.part AND a.label = 1 AND b.label <> 1 GROUP BY a.part),
n AS (SELECT part AS g, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS q FROM smp GROUP BY part)
SELECT g, {s6('CASE WHEN p > 0 AND q > 0 THEN t / (p * q) ELSE 0.5 END', 'auc')} FROM n LEFT JOIN pr USING (g)""",
    ),
    "class_counts": (lambda s, d: C.class_counts(samples(s, d), ["part"]), f"{with_('smp')} SELECT part, label, count(*) AS n FROM smp GROUP BY part, label"),
    "sample_cap": (
        lambda s, d: C.capped_sample(samples(s, d), ["sample_id"], 40, drawn=drawn()).select("label", "sample_id"),
        f"""{RANKED}, n AS (SELECT least(40, count(*)) AS f FROM smp WHERE label = 1)
SELECT label, sample_id FROM rk, n WHERE k <= CASE WHEN label = 1 THEN f ELSE 2 * f END""",
    ),
    "strat_split": (
        lambda s, d: C.stratified_split(samples(s, d), ["sample_id"], [("train", 0.8), ("calibrate", 0.1), ("validate", 0.1)], drawn=drawn()).select("label", "sample_id", "split"),
        f"{RANKED} SELECT label, sample_id, CASE WHEN k <= floor(c * 0.8::DOUBLE + 1e-9) THEN 'train' WHEN k <= floor(c * 0.9::DOUBLE + 1e-9) THEN 'calibrate' ELSE 'validate' END AS split FROM rk",
    ),
    "upsample": (
        lambda s, d: C.upsample_minority(table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") < 3, 1).otherwise(0).alias("label")), ["id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids")),
        "SELECT CAST(n_nationkey < 3 AS INT) AS label, greatest(count(*), 5) AS n, count(DISTINCT n_nationkey) AS n_ids FROM nation GROUP BY 1",
    ),
    "history_decay": (
        lambda s, d: C.history_budget(table(s, d, "events").select(F.col("user_id").alias("layer_id"), F.col("event_id").alias("frame_id")), 60).select("layer_id", "frame_id", F.col("age").cast("long").alias("age"), F.col("budget").cast("long").alias("budget")),
        "SELECT layer_id, frame_id, age, budget FROM (SELECT user_id AS layer_id, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events) JOIN (VALUES (0, 36), (1, 21), (2, 12), (3, 7), (4, 4)) b(age, budget) USING (age)",
    ),
    "fallback_field": (
        lambda s, d: r6(samples(s, d).select("sample_id", C.fallback_field(F.when(F.col("part") == 1, F.col("score")), F.col("sample_id") % 256).alias("p")), "p"),
        f"{with_('smp')} SELECT sample_id, {s6('CASE WHEN part = 1 THEN score ELSE (255 - sample_id % 256) / 255.0::DOUBLE END', 'p')} FROM smp",
    ),
}
