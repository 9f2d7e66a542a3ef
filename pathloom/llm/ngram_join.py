"""N-gram Jaccard self-join: documents whose sets of word n-grams overlap enough, as exact link components.

The overlap counts are a sparse product of the document by n-gram incidence matrix with its own transpose. It
is never formed as a whole. Four steps keep it blocked:

1. *Where rows meet, from size bounds.* At 90 % or more, sizes fall into bands; in a band with largest size r, two linked sets differ in at
   most 2 r (q-p)/(q+p) n-grams, so where hashes are cut into more ranges than that, they agree on a whole range that is not empty.
   A hash of each range is a mark, and holds six n-grams or more, which few other documents share. Under 90 % ranges would
   hold too few. A set of size a that links at p/q shares at least a p/q of its n-grams, so two linked sets share one of the
   first a - ceil(a p/q) + 1 in any common order; these are the marks. The order is by a hash, over half of the n-grams whose exact counts
   over all documents are at most COLUMN first, then over the other half, which isn't counted, then over the frequent ones of
   the first, so passages that many documents share come last.
2. *Blocks.* Each row hangs on the least of those that share a mark with it. Under 90 % rows of a mark of at most COLUMN rows are paired
   instead, once, where their sizes allow a link, and a pair goes when the sums of differences of both sets' counts in equal ranges of
   hashes already exceed the differences that the bound allows. Components are blocks; no link crosses them.
3. *Blocked product.* A block's rows are multiplied in one task, row by row through the column lists; pairs
   that can't reach the bound by their sizes, or by the triangle inequality of the Jaccard distance to rows
   already multiplied, are discarded before any counting, and accumulated counts below the bound after it. A
   block of more than one tile (TILE rows or TILE_SHINGLES n-grams) is first multiplied with the columns of PIVOTS of its own rows:
   rows that link to a pivot are in one tree and need no product among themselves. What is left is cut into tiles by
   tree, and each pair of tiles of different trees, or of rows without one, is a task of its own.
4. *Components.* The tasks return spanning links only; their components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.bytescan import Scan, U, mix, shingle_sets
from pathloom.llm.common import Scratch, chunks, map_rows, perhaps_in, shared_table, sliced, table
from pathloom.llm.components import components, keep_first

#: Rows and n-grams of one side of a tile pair, and the rows that all of a larger block are multiplied with first.
TILE, TILE_SHINGLES, PIVOTS = 512, 400_000, 8
#: Rows of a column that are paired with one another; least ranges of a histogram; and bits of an entry in the table of frequent n-grams.
COLUMN, HISTOGRAM, ENTRY_BITS = 32, 64, 27
#: N-grams whose counts a task adds up before it hands them on.
COUNTED = 2_000_000
_BAND_RATIO = 1.5
_ALL = (1 << 64) - 1


@lru_cache(maxsize=8)
def bands(p: int, q: int, largest: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(largest size, differences allowed at most, ranges) of each band of sizes, for a bound of p/q."""
    differ = lambda r: 2 * r * (q - p) // (q + p)
    r = 1
    while differ(r + 1) == 0:
        r += 1
    out = [(r, 0, 1)]
    while r < largest:
        low = (r + 1) * p // q
        r = max(r + 1, int(r * _BAND_RATIO))
        d, spare = differ(r), 0
        for _ in range(40):  # ranges that may be empty, with a margin
            k = d + 1 + spare
            mean = k * np.exp(-low / k)
            spare, before = int(np.ceil(mean + 4 * np.sqrt(mean))), spare
            if spare <= before:
                break
        out.append((r, d, d + 1 + spare))
    return out


def signatures(own: np.ndarray, p: int, q: int) -> np.ndarray:
    """The signatures of one sorted set of n-gram hashes."""
    n = len(own)
    if not n:
        return own
    table_ = bands(p, q)
    i = next(j for j, b in enumerate(table_) if b[0] >= n)
    top, mixed, out = own >> U(32), mix(own ^ U(0x5851F42D4C957F2D)), []
    last = next(j for j, b in enumerate(table_) if b[0] >= n * q // p)  # the band of the largest size that can link
    for j in range(i, last + 1):
        _, d, k = table_[j]
        part = (top * U(k)) >> U(32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        key = part[at] * U(0xD6E8FEB86659FD93) + U((j * 2 + 1) * 0xA0761D6478BD642F & _ALL)
        out.append(mix(np.add.reduceat(mixed, at) + mix(key)))
        if k - len(at) >= k - d:  # so many empty ranges that only an empty one may be shared
            empty = np.setdiff1d(np.arange(k, dtype=U), part[at])
            out.append(mix(empty * U(0xD6E8FEB86659FD93) + U(j * 2 * 0xA0761D6478BD642F & _ALL)))
    return np.concatenate(out)


def rarest(own: np.ndarray, frequent: np.ndarray, p: int, q: int) -> np.ndarray:
    """The n-grams of a sorted set by which it meets every set that it can link to: the first in the order that the module states."""
    n = len(own)
    k = n - -(-n * p // q) + 1
    if not 0 < k < n:
        return own
    order = mix(own)
    entry = (own >> U(64 - ENTRY_BITS)).astype(np.int64)
    listed = (frequent[entry >> 3] >> (entry & 7).astype(np.uint8)) & 1
    key = (np.where(order >> U(63), 1, 2 * listed).astype(U) << U(62)) | (order >> U(2))
    return own[np.argpartition(key, k - 1)[:k]]


def histogram(own: np.ndarray) -> bytes:
    """How many n-grams fall into each of equal ranges of hashes, at most 255; about eight to a range, HISTOGRAM ranges at least."""
    ranges = max(HISTOGRAM, 1 << (max(len(own) - 1, 1) // 8).bit_length())
    at = (own >> U(65 - ranges.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=ranges), 255).astype(np.uint8).tobytes()


def least_difference(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each two histograms a number that the two sets differ in at least: the sum of differences over the wider ranges."""
    out, size = np.zeros(len(a), np.int64), np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    for m, n in np.unique(size, axis=0).tolist():
        own = np.flatnonzero((size == (m, n)).all(1))
        for part in np.array_split(own, len(own) * max(m, n) // 8_000_000 + 1):
            x, y = (np.frombuffer(b"".join([h[i] for i in part.tolist()]), np.uint8).reshape(len(part), min(m, n), -1).sum(2, dtype=np.int64) for h in (a, b))
            out[part] = np.abs(x - y).sum(1)
    return out


def frequent_grams(docs: DataFrame, words: int) -> np.ndarray:
    """A bit for each entry (ENTRY_BITS first bits of a hash): whether it has an n-gram, of the counted half, of more than COLUMN documents.

    Counts are exact and over all documents; tasks add up their own first. The bits are gathered in 64-bit words, so what reaches the
    driver and every executor is of a fixed size, 2**ENTRY_BITS bits at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches):
            for _, _, sets in _profile(batch.column(0).to_pylist(), words):
                own = np.concatenate(sets)
                held.append(own[mix(own) >> U(63) == 0])
                n += len(held[-1])
                if n > COUNTED:
                    yield added(held)
                    held, n = [], 0
        yield added(held)

    def added(held: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate([*held, np.zeros(0, U)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

    entry = F.shiftrightunsigned("gram", 64 - ENTRY_BITS)
    counts = docs.select("text").mapInArrow(count, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > COLUMN)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(entry, F.lit(64)).cast("int"))
    found = counts.select(F.shiftright(entry, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (ENTRY_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def product_links(ids: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Spanning links (id, id of its tree's root) among the rows of one block, by a row-wise sparse product."""
    m = len(ids)
    if m < 2:
        return []
    order = sorted(range(m), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    many = np.bincount(column)[column] > 1  # a column of one row adds to no overlap
    column, row = column[many], row[many]
    by_column = np.argsort(column, kind="stable")
    posting, column_at = row[by_column], np.concatenate([[0], np.cumsum(np.bincount(column))]) if len(column) else np.zeros(1, int)
    row_at = np.searchsorted(row, np.arange(m + 1))
    tree = np.arange(m)
    pivots: list[np.ndarray] = []
    bound = (q - p) / q + 1e-9
    links = []
    for i in range(m - 1):
        later = np.arange(i + 1, m)
        later = later[(tree[i + 1 :] != tree[i]) & (size[i + 1 :] * p <= size[i] * q)]
        for far in pivots:
            if not len(later):
                break
            later = later[np.abs(far[later] - far[i]) <= bound]
        if not len(later):
            continue
        own = column[row_at[i] : row_at[i + 1]]
        hits = np.concatenate([posting[column_at[c] : column_at[c + 1]] for c in own.tolist()]) if len(own) else own
        count = np.bincount(hits, minlength=m)
        if len(pivots) < 8:
            pivots.append(1 - count / (size + size[i] - count))
        shared = count[later]
        for j in later[shared * q >= p * (size[later] + size[i] - shared)].tolist():
            if tree[j] != tree[i]:
                a, b = tree[i], tree[j]
                tree[tree == b] = a
                links.append((ids[j], ids[i]))
    return links


def overlaps(sets: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix of ``sets`` with that of ``columns``: n-grams in common, sets by columns."""
    every, row = np.concatenate([*sets, np.zeros(0, U)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(columns)), np.int64)
    for k, own in enumerate(columns):
        if len(own):
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            out[:, k] = np.bincount(row[hit], minlength=len(sets))
    return out


def links_of(sets: list[np.ndarray], columns: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Which of ``sets`` reach the bound with which of ``columns``."""
    both, m, n = overlaps(sets, columns), np.array([len(s) for s in sets], np.int64)[:, None], np.array([len(s) for s in columns], np.int64)[None]
    return (both > 0) & (both * q >= p * (m + n - both))


def pivot_forest(pivots: list[np.ndarray], p: int, q: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The least pivot that each pivot reaches by links among them, and the spanning links (later, earlier) by which it does."""
    tree, links = list(range(len(pivots))), []
    linked = links_of(pivots, pivots, p, q)
    for i in range(len(pivots)):
        for j in range(i):
            if tree[i] != tree[j] and linked[i, j]:
                low, high = sorted((tree[i], tree[j]))
                tree = [low if t == high else t for t in tree]
                links.append((i, j))
    return tree, links


def _profile(texts: list[str | None], n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b in chunks(texts):
        yield a, b, shingle_sets(Scan(texts[a:b], lower=True), n)


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, one row for each input row.

    Text is lower-cased (A-Z) and split into words at space and tab to carriage return; a document's set holds
    its distinct runs of ``words`` words, or its whole sequence where it has fewer. Documents link at
    100 * intersection >= percent * union; component_id is the smallest doc_id reached by links. A null, empty
    or blank text has an empty set, links with nothing and keeps its own doc_id. Rows with one doc_id count
    as one document. A null doc_id links with nothing and has a null component_id. Other columns are ignored.
    """
    p, q = percent, 100
    spark, scratch = docs.sparkSession, Scratch(plain_joins=True)

    def profile(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b, sets in _profile(texts, words):
            marks = [signatures(s, p, q) if whole_ranges else rarest(s, shared.value, p, q) for s in sets]
            same = [int(mix(s).sum()).to_bytes(8) + int(mix(s + U(1)).sum()).to_bytes(8) + len(s).to_bytes(5) if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in marks])]).astype(np.int32), np.concatenate(marks).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), lists, pa.array([histogram(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "same", "marks", "ranges"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = ([], []), None
        out = lambda links: pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])
        for batch in sliced(batches, 200):
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            ids, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for a, b, sets in _profile(texts, words):
                for k, doc, own in zip(keys[a:b], ids[a:b], sets):
                    if k != key:
                        yield out(product_links(*held, p, q))
                        held, key = ([], []), k
                    held[0].append(doc)
                    held[1].append(own)
        yield out(product_links(*held, p, q))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole_ranges = p * 10 >= q * 9
    shared = None if whole_ranges else spark.sparkContext.broadcast(frequent_grams(docs, words))  # fixed size: 2**ENTRY_BITS bits
    known = scratch.table(map_rows(docs, profile, "doc_id long, n_shingles long, same binary, marks array<long>, ranges binary"), "ngram-profile")
    full = known.where("doc_id is not null and n_shingles > 0")
    # minima are added up map-side and written, so that the joins back to the rows have plain exchanges on both
    # sides, which Spark splits where one text or one mark has many documents
    first = scratch.table(full.groupBy("same").agg(F.min("doc_id").alias("rep")), "ngram-first")
    member = scratch.table(known.select("doc_id", "n_shingles", "same").join(first, "same", "left").select("doc_id", "n_shingles", "rep"), "ngram-member")

    # one document stands for all of its text; rows that repeat its doc_id with other texts stay apart
    texts = scratch.table(full.join(first, (full["same"] == first["same"]) & (full["doc_id"] == first["rep"])).select("doc_id", "n_shingles", "marks", "ranges"), "ngram-texts")
    mark = texts.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("marks").alias("mark"))
    column = scratch.table(mark.groupBy("mark").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).cast("int").alias("c")).where("c > 1"), "ngram-columns")
    meet = mark.join(column, "mark")
    if whole_ranges:
        edges = meet.where("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    else:
        meet = scratch.table(meet, "ngram-meet")
        star = meet.where((F.col("c") > COLUMN) & (F.col("doc_id") != F.col("low"))).select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
        edges = star.union(_close_pairs(meet.where(F.col("c") <= COLUMN), texts, p, q, scratch))
    block = components(edges, scratch)
    block = block.union(block.select(F.col("component").alias("node"), "component").distinct())
    sizes = texts.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    block = scratch.table(block.join(sizes, F.col("node") == F.col("doc_id")).select("doc_id", "component", "n"), "ngram-blocks")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("parts")
    whole = scratch.table(block.groupBy("component").agg(parts), "ngram-sizes")
    tiles = block.join(whole.where("parts = 1"), "component").select("doc_id", "component", F.lit(0).alias("i"), F.lit(0).alias("j"))
    several, tied = whole.where("parts > 1"), None
    if not several.isEmpty():
        more, tied = _tree_tiles(docs, block.join(several, "component", "left_semi"), several, parts, words, p, q, scratch)
        tiles = tiles.unionByName(more)
    tiles = scratch.table(tiles, "ngram-tiles")
    # few texts are in a block
    work = perhaps_in(docs, "doc_id", tiles.select("doc_id")).join(tiles, "doc_id").select("component", "i", "j", "doc_id", "text")
    links = work.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id").mapInArrow(multiply, "u long, v long")

    # a doc_id with several texts links them
    twins = member.where("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    links = links.union(member.join(twins, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    found = components(links if tied is None else links.union(tied), scratch)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out, _ = shared_table(member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", own.alias("component_id")), "ngram-components")
    scratch.drop(spark)
    return out


def _close_pairs(short: DataFrame, texts: DataFrame, p: int, q: int, scratch: Scratch) -> DataFrame:
    """Pairs ``(u, v)`` of the rows ``short(mark, doc_id, n)``, COLUMN of a mark at most, whose sizes and histograms allow a link."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 20_000):
            pair = pa.table(batch)
            size = pair["nu"].to_numpy() + pair["nv"].to_numpy()
            keep = least_difference(pair["ru"].to_pylist(), pair["rv"].to_pylist()) <= size * (q - p) // (q + p)
            yield from pair.select(["u", "v"]).filter(pa.array(keep)).to_batches() or [pa.RecordBatch.from_pylist([], schema=pair.select(["u", "v"]).schema)]

    # each mark's rows by size, so that a pair's larger set comes later
    rows = short.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("n", "doc_id"))).alias("rows")).select("rows")
    fits = lambda a, b: (a["doc_id"] != b["doc_id"]) & (a["n"].cast("long") * q >= b["n"].cast("long") * p)
    later = lambda a, i: F.filter(F.slice(F.col("rows"), i + 2, COLUMN), lambda b: fits(a, b))
    pair = F.flatten(F.transform("rows", lambda a, i: F.transform(later(a, i), lambda b: F.struct(F.greatest(a["doc_id"], b["doc_id"]).alias("u"), F.least(a["doc_id"], b["doc_id"]).alias("v")))))
    pairs = scratch.table(rows.select(F.explode(pair).alias("p")).select("p.*").distinct(), "ngram-pairs")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(close, "u long, v long")


def _tree_tiles(docs: DataFrame, large: DataFrame, whole: DataFrame, parts: Column, words: int, p: int, q: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Tile pairs ``(doc_id, component, i, j)`` of the blocks ``large(doc_id, component, n)`` of ``whole(component, parts)``, and the links to pivots and among them ``(u, v)``.

    Pivots are the least ids of PIVOTS hash classes. A block's documents are dealt into as many groups as it has tiles; each
    group is streamed behind the pivots, so a task holds the pivots' sets and one chunk of documents. A pivot's own row brings
    the spanning links that joined it to earlier pivots, as rows of one tree are not multiplied with one another.
    """
    large = scratch.table(large.join(whole, "component").withColumn("group", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")), "ngram-large")
    pivot = large.groupBy("component", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS))).agg(F.min("doc_id").alias("doc_id")).select("component", "doc_id")
    pivot = scratch.table(pivot, "ngram-pivots")
    texts = perhaps_in(docs, "doc_id", pivot).join(pivot, "doc_id").groupBy("component", "doc_id").agg(F.min("text").alias("text")).join(whole, "component")
    first = texts.select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("group"), F.lit(0).alias("turn"), "doc_id", F.lit(0).cast("long").alias("n"), "text")
    rest = perhaps_in(docs, "doc_id", large).join(large, "doc_id").select("component", "group", F.lit(1).alias("turn"), "doc_id", "n", "text")
    rows = first.unionByName(rest).repartition("component", "group").sortWithinPartitions("component", "group", "turn", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own, tree, links = None, [], [], None, []
        for batch in sliced(batches, 200):
            component, group, turn, doc, n = (batch.column(c).to_pylist() for c in range(5))
            for a, b, sets in _profile(batch.column(5).to_pylist(), words):
                out, at = [], a
                while at < b:
                    if (component[at], group[at]) != key:
                        key, ids, own, tree, links = (component[at], group[at]), [], [], None, []
                    end = next((k for k in range(at, b) if (component[k], group[k], turn[k]) != (*key, turn[at])), b)
                    if turn[at] == 0:
                        ids += doc[at:end]
                        own += sets[at - a : end - a]
                    else:
                        if tree is None:
                            tree, links = pivot_forest(own, p, q)
                        met = links_of(sets[at - a : end - a], own, p, q)
                        for r, k in zip(range(at, end), np.where(met.any(1), met.argmax(1), -1).tolist()):
                            out.append((component[r], doc[r], n[r], None if k < 0 else ids[k], -1 if k < 0 else tree[k], [ids[j] for i, j in links if ids[i] == doc[r]]))
                    at = end
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["component", "doc_id", "n", "pivot", "tree", "earlier"])

    # rows with one doc_id have equal links to earlier pivots
    kept = (F.max("n").alias("n"), F.max_by("pivot", "tree").alias("pivot"), F.max("tree").alias("tree"), F.max("earlier").alias("earlier"))
    treed = rows.mapInArrow(compare, "component long, doc_id long, n long, pivot long, tree int, earlier array<long>").groupBy("component", "doc_id").agg(*kept)
    treed = scratch.table(treed, "ngram-trees")
    own = treed.groupBy("component", "tree").agg(parts)  # PIVOTS + 1 rows a block at most
    w = Window.partitionBy("component").orderBy("tree")
    own = own.withColumn("at", F.coalesce(F.sum("parts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    every = F.collect_list(F.struct("tree", "parts", "at")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = scratch.table(own.withColumn("every", every), "ngram-tree-sizes")
    placed = treed.join(own, ["component", "tree"]).withColumn("own", (F.col("at") + F.pmod(F.xxhash64("doc_id"), "parts")).cast("int"))
    others = F.flatten(F.transform(F.filter("every", lambda e: (e["tree"] != F.col("tree")) | (F.col("tree") == -1)), lambda e: F.sequence(e["at"], e["at"] + e["parts"] - 1)))
    tiles = placed.select("doc_id", "component", "own", F.explode(others).alias("t")).select("doc_id", "component", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"))
    tied = treed.where("pivot <> doc_id").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"))
    return tiles, tied.union(treed.select(F.col("doc_id").alias("u"), F.explode("earlier").alias("v")))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id, with all its columns, as ``components.keep_first`` says.

    Rows without words link with nothing and stay.
    """
    return keep_first(docs, lambda d: jaccard_components(d, words, percent))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach(u, v) AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(v) FROM reach WHERE reach.u = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
