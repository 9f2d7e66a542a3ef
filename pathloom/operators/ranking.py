"""Ranks over whole tables without gathering a table, or a key's rows, in one task.

Rows are cut into buckets along the order; the buckets' counts (a small table: keys times buckets, or the number of
partitions) give each bucket's offset, and only the rows of one bucket are ranked together.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.shared import written

#: Buckets of one key; one has a few million rows where a key has 10**10.
BUCKETS = 4096


def global_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Each row's place (from 0) in the order of the whole table; rows that are equal in it keep some order.

    The rows are range-partitioned, equal ones by a hash and their place in the input, written once, and numbered by partition.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tie = df.withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_place", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(int(parts), *order, "_tie", "_place").sortWithinPartitions(*order, "_tie", "_place").drop("_tie", "_place")
    kept = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return kept.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def hashed_rank(df: DataFrame, keys: list[str], unique: list[str], seed: int = 0, buckets: int = BUCKETS, drawn: Column | None = None) -> DataFrame:
    """A rank (``_rank``, from 1) of each row among its key's rows in a pseudo-random, repeatable order, and their number (``_count``).

    ``unique`` are the columns that tell a key's rows apart; the order is that of 40 bits of their hash with the seed, or of ``drawn``, a number
    in 0..2**40 - 1, whatever the number of buckets.
    """
    drawn = F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *unique), 16), F.lit(1 << 40)) if drawn is None else drawn
    hashed = df.withColumn("_hash", drawn).withColumn("_bucket", F.floor(F.col("_hash") * buckets / (1 << 40)).cast("int"))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_bucket"))]
    offsets = counts.select(*named, F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_count"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", *unique))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_bucket"))))
    joined = hashed.join(offsets, on).drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    return joined.withColumn("_rank", inside + F.col("_before")).drop("_hash", "_bucket", "_before")


def score_counts(scores: DataFrame, keys: list[str], weights: dict[str, Column], score: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """For each key and distinct score in [0, 1]: each weight's sum at that score, and its sum at lower scores (``less_*``).

    Rows are added up by distinct score before anything is ordered, so neither a frequent score nor a large key is hot.
    """
    own = scores.groupBy(*keys, score).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    own = own.withColumn("_bucket", F.floor(F.col(score) * buckets))
    small = own.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in weights])
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_before_{n}") for n in weights])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = own.withColumns({f"less_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in weights})
    out = ranked.join(offsets, [*keys, "_bucket"])
    return out.select(*keys, score, *weights, *[(F.col(f"less_{n}") + F.col(f"_before_{n}")).alias(f"less_{n}") for n in weights])


def lower_percentiles(df: DataFrame, keys: list[str], value: str, q: float, buckets: int = BUCKETS, most: int = 1_000_000) -> DataFrame:
    """``(keys, value)``: of each key's values, nulls left out, the one at place floor(q * (n - 1)) of their order, q in [0, 1].

    Equal values are added up first. Each round cuts the range that holds the place into ``buckets`` by value, and keeps one of them, until it has
    ``most`` distinct values at most; only these are ordered in a task, so a key may have any share of the rows. Keys with no value drop out.
    """
    own = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "distinct-values")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    kept = [f"_k{i}" for i in range(len(keys))]
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
    inside = F.count(F.lit(1)).alias("_c")
    state = own.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), inside)
    state = state.select(*named, F.floor(F.lit(q) * (F.col("_all") - 1)).alias("_place"), "_lo", "_hi", "_c")
    while True:
        state = written(state, "percentile-range")
        rows = own.join(state, on).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if state.where(F.col("_c") > most).isEmpty():
            break
        wide = F.col("_hi") / 2 - F.col("_lo") / 2  # halves, as the difference of two doubles may be none
        bucket = F.when(wide > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / wide * buckets), F.lit(buckets - 1))).otherwise(0)
        sums = rows.groupBy(*kept, "_place", bucket.alias("_bucket")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), inside)
        w = Window.partitionBy(*kept).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        here = (F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n"))
        state = sums.where(here).select(*kept, (F.col("_place") - F.col("_before")).alias("_place"), "_lo", "_hi", "_c")
    w = Window.partitionBy(*kept).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("_upto", F.sum("_n").over(w))
    return upto.where(F.col("_upto") > F.col("_place")).groupBy(*keys).agg(F.min("_v").alias(value))
