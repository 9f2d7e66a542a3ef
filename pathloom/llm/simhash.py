"""SimHash near-duplicates: fingerprints within a few bits of one another, found by BK-trees over shards of them.

A BK-tree keeps, for each node, one child for each Hamming distance to it; a search within r follows only the edges of d - r to d + r, d being the
query's distance to the node. One tree of all fingerprints would have to be sent everywhere and grows with the corpus, so trees are built
over shards that no link leaves: the 64 bits are cut into r + 2 parts, two fingerprints that differ in r bits agree on two of these at least,
and a shard holds what agrees on two given parts. A shard of more than SHARD fingerprints is cut again by the bits that its own still
differ in, until FREE_BITS are left, so a tree has 2 ** FREE_BITS nodes at most, whatever the input. What is still over SHARD then is
searched in chunks of its queries, and its tree is sent to each of them. Nothing of this goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bytescan import U, Scan, pieces
from pathloom.llm.common import Scratch, chunks, map_rows, shared_table, table
from pathloom.llm.components import components, keep_first

#: Fingerprints of a shard that one task searches by itself; bits that a shard's own may still differ in when it is cut no more.
SHARD, FREE_BITS = 2048, 16
#: Characters of a piece of a long text, and shingles hashed at a time; rows that a task holds before it searches them.
PIECE, BLOCK, HELD = 2_000_000, 50_000, 20_000
GAPS, WORDS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
#: Pairs of queries and nodes that a search holds at a time, about.
FRONT = 2_000_000


def shingle_bits(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many of its shingles' hashes have each bit (first the highest), and how many shingles it has."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for a, b in chunks(texts):
        for row, held in _pieces(texts, a, b, words):
            scan = Scan(held, lower=True)
            size = scan.word_end - scan.word_start
            start = np.concatenate([[0], np.cumsum(size + 1)])  # of each word where one space follows each
            spaced = np.full(start[-1], 0x20, np.uint8)
            spaced[np.delete(np.arange(start[-1]), start[1:] - 1)] = scan.data[~scan.gap]
            raw = spaced.tobytes()
            first, last = scan.word_bounds()
            n = last - first
            short = np.flatnonzero((n > 0) & (n < words))
            long = np.flatnonzero(n >= words)
            run = np.concatenate([np.arange(first[i], last[i] - words + 1) for i in long.tolist()] + [first[short]]).astype(np.int64)
            stop = np.concatenate([np.arange(first[i] + words, last[i] + 1) for i in long.tolist()] + [last[short]]).astype(np.int64)
            doc = row[np.concatenate([np.repeat(long, n[long] - words + 1), short]).astype(np.int64)]
            for at in range(0, len(run), BLOCK):
                ends, own = (start[stop[at : at + BLOCK]] - 1).tolist(), doc[at : at + BLOCK]
                h = np.array([xxhash.xxh64_intdigest(raw[i:j], 42) for i, j in zip(start[run[at : at + BLOCK]].tolist(), ends)], U)
                edge = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                np.add.at(ones, own[edge], np.add.reduceat(bits, edge, axis=0, dtype=np.int64))
                np.add.at(total, own[edge], np.diff(np.append(edge, len(own))))
    return ones, total


def _pieces(texts: list[str | None], a: int, b: int, words: int) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """Texts a to b with their rows; a long one in pieces, each behind the words of the piece before that its first shingles hold."""
    if b - a > 1 or not texts[a] or len(texts[a]) <= PIECE:
        yield np.arange(a, b), texts[a:b]
    else:
        for piece, _ in pieces(texts[a], PIECE, GAPS, WORDS, words - 1):
            yield np.array([a]), [piece]


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Each text's fingerprint: the bits that more than half of its shingles' hashes have; zero where there are no words."""
    ones, total = shingle_bits(texts, words)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(U)


class Forest:
    """BK-trees of many shards at once. ``shard`` numbers each value's tree, from 0 and rising; a tree's values are distinct."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        self.value = value
        self.root = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        self.tree = shard
        at = self.root[shard]  # the node that a value has come down to
        left = np.flatnonzero(at != np.arange(len(value)))
        edges, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):  # the first to come to a free place stays, all others go on below it
            edge = at[left] * 65 + np.bitwise_count(value[left] ^ value[at[left]])
            place, first, own = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(place)
            nodes.append(left[first])
            at[left] = left[first][own]
            left = np.delete(left, first)
        order = np.argsort(np.concatenate(edges))
        self.edge, self.child = np.concatenate(edges)[order], np.concatenate(nodes)[order]

    def near(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, other) for every value within ``radius`` of each query in its own tree, itself left out; values by index."""
        largest = int(np.bincount(self.tree).max()) if len(self.tree) else 1
        step = max(64, FRONT // largest)
        for k in range(0, len(query), step):
            q = query[k : k + step]
            node = self.root[self.tree[q]]
            while len(q):
                d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
                hit = (d <= radius) & (q != node)
                yield q[hit], node[hit]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 1))
                n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right") - low
                q = np.repeat(q, n)
                node = self.child[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def least_reached(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least of 0..n-1 that each reaches over the links (u, v), beyond those that ``label`` holds already."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _cuts(mask: int, radius: int) -> list[int]:
    """``mask`` with two of the radius + 2 parts of the bits that it lacks, in every way."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << i for i in part) for part in np.array_split(np.array(free, object), radius + 2)]
    return [mask | a | b for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``prints(print, rep)``, distinct prints -> ``(mask, key, print, rep, c)``: shards of ``c`` prints, two at least, that no link leaves."""
    spark, ready, masks = prints.sparkSession, [], [0]
    rows = prints.select(F.lit(0).cast("long").alias("mask"), "print", "rep")
    while True:
        wider = {m: _cuts(m, radius) for m in masks}
        last = all(64 - w.bit_count() <= FREE_BITS for ws in wider.values() for w in ws)
        cut = spark.createDataFrame([(_signed(m), [_signed(w) for w in ws]) for m, ws in wider.items()], "mask long, wider array<long>")  # fixed by the radius
        dealt = rows.join(F.broadcast(cut), "mask").select(F.explode("wider").alias("mask"), "print", "rep").withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        several = scratch.table(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "simhash-shards")
        rows = scratch.table(dealt.join(several, ["mask", "key"]).select("mask", "key", "print", "rep", "c"), "simhash-dealt")
        ready.append(rows if last else rows.where(F.col("c") <= SHARD))
        rows = rows.where(F.col("c") > SHARD)
        if last or rows.isEmpty():
            return reduce(DataFrame.unionByName, ready)
        masks = sorted({w for ws in wider.values() for w in ws})


def links(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links ``(u, v)`` among the ``rep`` of ``prints(print, rep)`` that span the components of prints within ``radius`` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= HELD:  # the last shard may go on in the next batch
                rows = pa.concat_tables(held)
                key = [rows[c].to_numpy() for c in ("mask", "key", "chunk")]
                end = np.flatnonzero(reduce(np.logical_or, (k != k[-1] for k in key)))
                full = int(end[-1]) + 1 if len(end) else 0
                if full:
                    yield found(rows.slice(0, full))
                held, size = [rows.slice(full)], rows.num_rows - full
        if size:
            yield found(pa.concat_tables(held))

    def found(rows: pa.Table) -> pa.RecordBatch:
        key = [rows[c].to_numpy() for c in ("mask", "key", "chunk")]
        new = reduce(np.logical_or, (k[1:] != k[:-1] for k in key))
        forest = Forest(np.concatenate([[0], np.cumsum(new)]), rows["print"].to_numpy().view(U))
        label = np.arange(rows.num_rows)
        for u, v in forest.near(np.flatnonzero(rows["own"].to_numpy(zero_copy_only=False)), radius):
            label = least_reached(len(label), u, v, label)
        rep, moved = rows["rep"].to_numpy(), np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["u", "v"])

    part = F.ceil(F.col("c") / SHARD).cast("int")
    every = shards(prints, radius, scratch).withColumn("chunk", F.explode(F.sequence(F.lit(0), part - 1)))
    every = every.select("mask", "key", "chunk", "print", "rep", (F.pmod(F.xxhash64("print"), part) == F.col("chunk")).alias("own"))
    return every.repartition("mask", "key", "chunk").sortWithinPartitions("mask", "key", "chunk", "print").mapInArrow(search, "u long, v long")


def near_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row for each input row.

    Text is lower-cased (A-Z) and split into words at space and tab to carriage return; every run of ``words`` words, repeats included, or the
    whole sequence where there are fewer, is joined by spaces and hashed by XXH64 (seed 42). A fingerprint bit is 1 where more than half
    of the hashes have it; a null, empty or blank text has the fingerprint zero and links like any other. Documents link where their fingerprints
    differ in at most ``radius`` bits; component_id is the smallest doc_id reached by links. Rows with one doc_id count as one document. A
    null doc_id links with nothing and has a null component_id. Other columns are ignored; an empty table gives an empty one.
    """

    def profile(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), words).view(np.int64))], ["doc_id", "print"])

    spark, scratch = docs.sparkSession, Scratch()
    member = scratch.table(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), profile, "doc_id long, print long"), "simhash-prints")
    known = member.where("doc_id is not null")
    first = scratch.table(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "simhash-first")
    # a doc_id with several prints links them
    twins = known.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("doc_id")
    twins = known.join(twins, "doc_id", "left_semi").join(first, "print").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links(first, radius, scratch).union(twins), scratch)
    least = first.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("least"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("least"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    out, _ = shared_table(member.join(least, "print", "left").select("doc_id", digits.alias("fingerprint"), own.alias("component_id")), "simhash-components")
    scratch.drop(spark)
    return out


def deduplicate(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id, with all its columns, as ``components.keep_first`` says."""
    return keep_first(docs, lambda d: near_components(d, words, radius))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
