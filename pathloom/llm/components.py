"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

A step moves only nodes that it changes: the large-star those with neighbours on both sides, the small-star those with several smaller
ones. These are few, are written as tables of their own, and are joined to the edges by plain exchanges, which Spark splits (or by
a broadcast where the table's files are small), so a hub's edges are not one task; minima are added up before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, drop_path, exchanged, shared_table


def _large(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Every node's larger neighbours are linked to the least of it and its neighbours; and whether anything moved."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    between = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).where("m < u and u < top").select(F.col("u").alias("w"), "m")
    between = scratch.table(between, "components-between")
    if between.isEmpty():
        return e, False
    # edges are (u, v) with u > v: those of v's larger neighbours
    moved = e.join(between, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
    out, path = shared_table(moved.distinct(), "components-large")  # may be joined with a broadcast of few nodes
    scratch.paths.append(path)
    return out, True


def _small(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Every node and its smaller neighbours are linked to the least of these; and whether anything moved."""
    forked = scratch.table(e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).where("m < top").select(F.col("u").alias("w"), "m"), "components-forked")
    if forked.isEmpty():
        return e, False
    joined = e.join(forked, F.col("u") == F.col("w"), "left")
    stay = joined.select("u", F.coalesce("m", "v").alias("v"))
    return stay.union(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), True


def components(edges: DataFrame, owner: Scratch | None = None) -> DataFrame:
    """``edges(u, v)`` (longs, no nulls) -> ``(node, component)`` for every node that is not its component's smallest.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at
    most; the last round's table goes with ``owner``'s. The number of rounds grows with the logarithm of the longest path. An
    empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, path = shared_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while True:
        scratch = Scratch(plain_joins=True)
        large, one = _large(now, scratch)
        then, two = _small(large, scratch)
        if one or two:
            new = shared_table(then, "components")
            drop_path(spark, path)
            now, path = new
        scratch.drop(spark)
        if not one and not two:
            if owner:
                owner.paths.append(path)
                now = exchanged(now, path) if owner.plain_joins else now
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def keep_first(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id, with all its columns.

    ``find`` gives ``(doc_id, component_id)`` for ``(doc_id, text)``. Where a doc_id has several texts, the one with the least hash bears it and
    the others get ids of their own, above all below 2**62, so each is kept or goes by its own links. Of rows that agree in doc_id and
    text one stays, the least in JSON form. Rows with a null doc_id stay. Only ids that lose a row are written and joined.
    """
    key = docs["doc_id"].cast("long")
    repeated, path = shared_table(docs.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-ids")
    several = not repeated.isEmpty()
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    if several:
        own = F.xxhash64("row.text")
        low, path = shared_table(rows.join(exchanged(repeated, path), F.col("key") == F.col("id"), "left_semi").groupBy(F.col("key").alias("id")).agg(F.min(own).alias("low")), "repeated-least")
        other = F.shiftrightunsigned(F.xxhash64("key", own), 2).bitwiseOR(F.lit(1 << 62))
        rows = rows.join(exchanged(low, path), F.col("key") == F.col("id"), "left").select(F.when(own > F.col("low"), other).otherwise(F.col("key")).alias("key"), "row", F.col("low").isNotNull().alias("again"))
    found = find(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    loses, path = shared_table(found.where("component_id <> doc_id").select(F.col("doc_id").alias("lost")).distinct(), "duplicates")
    out = rows.join(exchanged(loses, path), F.col("key") == F.col("lost"), "left_anti")
    if several:
        once = out.where("again").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.where("not again").select("row").union(once.select("row"))
    return out.select("row.*")
