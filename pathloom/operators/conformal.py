"""Conformal uncertainty of classifiers' scores: p-values, prediction sets, forest weights and probability fields.

Scores are rows (forest, sample_id, p0, p1); labels are 0 and 1. Calibration counts come from sums by distinct score,
so neither the test nor the calibration rows of a forest are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.ranking import hashed_rank, score_counts

EPSILON, LAMBDA, THETA = 0.05, 0.9, 0.75


def conformity(p_own: Column, p_other: Column) -> Column:
    """(1 + own - other) / 2."""
    return (1.0 + p_own - p_other) / 2.0


def long_scores(scores: DataFrame, *more: str) -> DataFrame:
    """A row for each class y: (forest, sample_id, y, score), with columns ``more`` kept."""
    both = F.array(*[F.struct(F.lit(y).alias("y"), conformity(F.col(f"p{y}"), F.col(f"p{1 - y}")).alias("score")) for y in (0, 1)])
    return scores.select("forest", "sample_id", *more, F.inline(both))


def p_values(test: DataFrame, calibration: DataFrame, tau: Column | float | None = None) -> DataFrame:
    """``test(forest, sample_id, y, score)`` with ``p`` = (less + tau * equal) / (n + 1) among the calibration scores of its class.

    ``calibration(forest, label, y, score)`` counts where label = y. A class without calibration rows has p = 0. ``tau`` in
    [0, 1) breaks ties: a number, or a column; a hash of the row where none is given.
    """
    cal = calibration.where("label = y").select("forest", "y", "score", F.lit(1).alias("n"))
    counts = score_counts(cal.unionByName(test.select("forest", "y", "score", F.lit(0).alias("n"))), ["forest", "y"], {"equal": F.col("n")})
    total = cal.groupBy("forest", "y").agg(F.count(F.lit(1)).alias("n_cal"))
    if tau is None:
        tau = F.pmod(F.xxhash64("forest", "sample_id", "y"), F.lit(1 << 30)) / float(1 << 30)
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    out = test.join(counts, ["forest", "y", "score"]).join(F.broadcast(total), ["forest", "y"], "left")
    p = (F.col("less_equal") + tau * F.col("equal")) / (F.col("n_cal") + 1.0)
    return out.withColumn("p", F.coalesce(p, F.lit(0.0))).drop("equal", "less_equal", "n_cal")


def untrained_p_values(test: DataFrame) -> DataFrame:
    return test.withColumn("p", F.lit(0.5))


def prediction_set(p: Column, epsilon: float = EPSILON) -> Column:
    return p > epsilon


def cdum(p: DataFrame, lam: float = LAMBDA, epsilon: float = EPSILON) -> DataFrame:
    """``p(forest, sample_id, label, p0, p1)`` -> (forest, y, u): lam * phi + (1 - lam) * psi.

    phi: mean over rows of class y of (size of the prediction set - membership of y), an empty set counting 1. psi: share
    of the other rows whose set holds y. Without such rows either is 1.
    """
    s = [prediction_set(F.col(f"p{y}"), epsilon).cast("int") for y in (0, 1)]
    size = s[0] + s[1]
    out = None
    aggregates = []
    for y in (0, 1):
        rho = F.when(size > 0, size - s[y]).otherwise(1)
        aggregates += [F.coalesce(F.avg(F.when(F.col("label") == y, rho)), F.lit(1.0)).alias(f"phi{y}"), F.coalesce(F.avg(F.when(F.col("label") != y, s[y])), F.lit(1.0)).alias(f"psi{y}")]
    out = p.groupBy("forest").agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(y).alias("y"), (lam * F.col(f"phi{y}") + (1.0 - lam) * F.col(f"psi{y}")).alias("u")) for y in (0, 1)])
    return out.select("forest", F.inline(rows))


def lower_percentile(values: Column, q: float) -> Column:
    """The q-th share's value of an aggregated column by the 'lower' rule: element floor(q * (n - 1)) of the sorted values.

    For groups of a bounded size (a layer's forests); ``ranking.lower_percentiles`` takes groups of any size."""
    every = F.array_sort(F.collect_list(values))
    return F.element_at(every, F.floor(F.lit(q) * (F.size(every) - 1)).cast("int") + 1)


def normalised(u: DataFrame, theta: float = THETA) -> DataFrame:
    """Adds norm = u / (sum over forests + 1e-8), the threshold of each class, and whether the forest is filtered out.

    The threshold is the lower percentile at ceil((T + 1) * theta) / T, at most 1; the test is strict, so a threshold
    at the maximum filters nothing.
    """
    w = Window.partitionBy("y")
    u = u.withColumn("norm", F.col("u") / (F.sum("u").over(w) + 1e-8)).withColumn("_t", F.count(F.lit(1)).over(w))
    every = F.array_sort(F.collect_list("norm").over(w))
    q = F.least(F.ceil((F.col("_t") + 1) * F.lit(theta)) / F.col("_t"), F.lit(1.0))
    u = u.withColumn("threshold", F.element_at(every, F.floor(q * (F.col("_t") - 1)).cast("int") + 1))
    return u.withColumn("filtered", F.col("norm") > F.col("threshold")).drop("_t")


def weights(u: DataFrame) -> DataFrame:
    """max(0, (1 - u) / (1 + u + 1e-8)), normalised over the forests of a class; equal weights where all are 0."""
    w = Window.partitionBy("y")
    raw = F.greatest((1.0 - F.col("u")) / (1.0 + F.col("u") + 1e-8), F.lit(0.0))
    u = u.withColumn("_w", raw)
    total = F.sum("_w").over(w)
    return u.withColumn("weight", F.when(total > 0, F.col("_w") / total).otherwise(1.0 / F.count(F.lit(1)).over(w))).drop("_w")


def aggregate_forests(p: DataFrame, weight: DataFrame) -> DataFrame:
    """(sample_id, y, p): each class's p-values weighted over the forests. ``weight`` has a row for each forest and class."""
    return p.join(F.broadcast(weight.select("forest", "y", "weight")), ["forest", "y"]).groupBy("sample_id", "y").agg(F.sum(F.col("p") * F.col("weight")).alias("p"))


def probability_field(p: DataFrame, frame: list[str], epsilon: float = EPSILON, value: str = "p") -> DataFrame:
    """Adds ``field``: p * (0.7 + 0.3 where p > epsilon), divided by its frame's maximum where that is over 0.

    The maximum is an aggregate joined back, so that one large frame isn't one task.
    """
    raw = F.col(value) * F.when(F.col(value) > epsilon, F.lit(1.0)).otherwise(0.7)
    df = p.withColumn("_raw", raw)
    top = df.groupBy(*frame).agg(F.max("_raw").alias("_top"))
    return df.join(top, frame).withColumn("field", F.when(F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(F.col("_raw"))).drop("_raw", "_top")


def fallback_field(p: Column, v: Column) -> Column:
    """The field where there is one, else the inverse gray value."""
    return F.coalesce(p, (255 - v) / 255.0)


def auc(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve of ``score`` in [0, 1] for ``label`` 0 or 1, by rank sums; 0.5 where a label lacks."""
    keys = keys or []
    df = scored.withColumn("_k", F.lit(0)) if not keys else scored
    own = keys or ["_k"]
    counts = score_counts(df, own, {"pos": F.when(F.col("label") == 1, 1).otherwise(0), "neg": F.when(F.col("label") == 1, 0).otherwise(1)})
    out = counts.groupBy(*own).agg(F.sum(F.col("pos") * (F.col("less_neg") + F.col("neg") / 2.0)).alias("_s"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    area = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_s") / (F.col("_p") * F.col("_n"))).otherwise(0.5)
    return out.select(*keys, area.alias("auc"))


# --- samples ---


def class_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), "label").agg(F.count(F.lit(1)).alias("n"))


def capped_sample(df: DataFrame, unique: list[str], most: int | None = None, ratio: int = 2, seed: int = 0, keys: list[str] | None = None, drawn: Column | None = None) -> DataFrame:
    """At most ``most`` rows of label 1, and at most ``ratio`` times as many of label 0, picked by hashed ranks without replacement.

    ``drawn``: another hash to rank by than that of ``unique`` with the seed."""
    keys = keys or []
    ranked = hashed_rank(df, [*keys, "label"], unique, seed, drawn=drawn)
    fg = df.where("label = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("_fg"))
    ranked = ranked.join(fg, keys, "left") if keys else ranked.crossJoin(F.broadcast(fg))  # one row
    cap = F.least(F.coalesce("_fg", F.lit(0)), F.lit(most)) if most else F.coalesce("_fg", F.lit(0))
    return ranked.where(F.col("_rank") <= F.when(F.col("label") == 1, cap).otherwise(cap * ratio)).drop("_rank", "_count", "_fg")


def stratified_split(df: DataFrame, unique: list[str], shares: list[tuple[str, float]], seed: int = 42, keys: list[str] | None = None, drawn: Column | None = None) -> DataFrame:
    """Adds ``split``: each label's rows in a hashed order (``drawn`` where it is given) are cut at the cumulative shares of their number."""
    ranked = hashed_rank(df, [*(keys or []), "label"], unique, seed, drawn=drawn)
    out, at = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(F.col("_rank") <= F.floor(F.col("_count") * F.lit(at) + 1e-9), F.lit(name)).otherwise(out)
        at -= share
    return ranked.withColumn("split", out).drop("_rank", "_count")


def upsample_minority(df: DataFrame, unique: list[str], least: int = 5, seed: int = 0) -> DataFrame:
    """Labels with fewer than ``least`` rows are filled up to it by repeats of their rows, in hashed order."""
    ranked = hashed_rank(df, ["label"], unique, seed)
    times = F.when(F.col("_count") >= least, 1).otherwise(F.floor((F.lit(least) - F.col("_rank")) / F.col("_count")) + 1)
    return ranked.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).drop("_i", "_rank", "_count")


def history_budget(history: DataFrame, n_now: int, decay: float = 0.6, least: int = 4, most: int = 5, key: str = "layer_id", frame: str = "frame_id") -> DataFrame:
    """The last ``most`` frames of each layer with their sample budget: max(least, floor(n * decay^(k + 1))), k from 0 for the newest."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.col(frame).desc()))
    return history.withColumn("age", k - 1).where(F.col("age") < most).withColumn("budget", F.greatest(F.lit(least), F.floor(F.lit(float(n_now)) * F.pow(F.lit(decay), F.col("age") + 1))))
