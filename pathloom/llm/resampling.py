"""Importance resampling towards a target distribution over hashed runs of words (Xie et al., 2023).

Texts are read in slices. A slice's distinct words get integer ids, its runs of words are tuples of ids, each distinct tuple's bytes are
put together and hashed once, and the counts of documents or of buckets are joined back to the tuples by id. The hash of a tuple depends on
its bytes alone, so a slice's dictionary can be dropped with it: a dictionary of the whole corpus would grow with it, and would need all of
its words in a shuffle. What tasks hand on is one count a bucket; the gains of the buckets are all that is broadcast, and of a fixed size.

The draw is the Gumbel top-k trick: a document's log weight plus a noise that depends on its id, highest first. Scores are ranked by range
partitions, over the whole table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bytescan import Scan, pieces
from pathloom.llm.common import Scratch, shared_table, sliced, table
from pathloom.operators.ranking import global_index

#: Bytes between words, once A-Z are lower-cased: ASCII other than digits and a-z.
GAP = np.arange(256) < 128
GAP[48:58] = GAP[97:123] = False
GAPS, WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of one slice. Longer texts are cut between words.
SLICE = 4_000_000


def dictionary(scan: Scan) -> tuple[np.ndarray, list[bytes]]:
    """Each word's id, and the distinct words by id."""
    bounds = np.concatenate([[0], np.cumsum(scan.word_end - scan.word_start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(scan.data[~scan.gap])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist()


def hashed_runs(scan: Scan, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each length up to ``most``: the first word of each run, its tuple's number, the distinct tuples' buckets, and the length."""
    ids, words = dictionary(scan)
    at, own, tuples = np.arange(len(ids)), ids.astype(np.int64), np.arange(len(words))[:, None]
    for n in range(1, most + 1):
        if n > 1:  # a run of n words is one of n - 1 and a word more, of the same text
            inside = np.flatnonzero(at + n - 1 < len(ids))
            inside = inside[scan.word_doc[at[inside]] == scan.word_doc[at[inside] + n - 1]]
            at, own = at[inside], own[inside] * len(words) + ids[at[inside] + n - 1]
            _, first, own = np.unique(own, return_index=True, return_inverse=True)
            tuples = ids[at[first][:, None] + np.arange(n)]
        bucket = [zlib.crc32(b" ".join([words[i] for i in t])) % buckets for t in tuples.tolist()]
        yield at, own, np.array(bucket, np.int64), n


def scans(texts: list[str | None], most: int) -> Iterator[tuple[Scan, np.ndarray, np.ndarray]]:
    """Slices of at most SLICE characters: their words, each piece's row, and how many words of its start were counted in the piece before."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for piece, again in pieces(text or "", SLICE, GAPS, WORDS, most - 1):
            if held and size + len(piece) > SLICE:
                yield _scan(held)
                held, size = [], 0
            held.append((piece, row, again))
            size += len(piece)
    if held:
        yield _scan(held)


def _scan(held: list[tuple[str, int, int]]) -> tuple[Scan, np.ndarray, np.ndarray]:
    return Scan([p for p, _, _ in held], lower=True, space=GAP), np.array([r for _, r, _ in held]), np.array([a for _, _, a in held])


def features(texts: list[str | None], most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each slice and length of runs: each run's row, its tuple's number, the tuples' buckets, and the length."""
    for scan, row, again in scans(texts, most):
        first = scan.word_bounds()[0]
        for at, own, bucket, n in hashed_runs(scan, most, buckets):
            piece = scan.word_doc[at]
            new = at + n - 1 >= first[piece] + again[piece]  # it ends behind what the piece before held
            yield row[piece[new]], own[new], bucket, n


def bucket_counts(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall into each bucket. Every task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            for _, own, bucket, _ in features(batch.column(0).to_pylist(), most, buckets):
                np.add.at(total, bucket, np.bincount(own, minlength=len(bucket)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times each bucket's log ratio of smoothed target and source frequencies, rounded down."""
    s, t, smooth = float(source.sum() + len(source)), float(target.sum() + len(target)), lambda n: float(n + 1)
    return np.array([math.floor(1000 * math.log(smooth(b) * s / (smooth(a) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_features, weight)``, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, own, bucket, n in features(batch.column(1).to_pylist(), most, len(gain)):
                count = np.bincount(row, minlength=batch.num_rows)
                n_features += count
                n_words += count if n == 1 else 0
                np.add.at(weight, row, gain[bucket][own])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """``docs(doc_id, text)`` and ``target(text)`` -> ``(doc_id, n_words, n_features, weight, score, rank)``, one row for each row of ``docs``.

    A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII, features all runs of 1 to ``most`` of them. Of the documents
    with ``least`` words, ``percent`` in a hundred are drawn (rounded down): highest scores first, ties to the smaller doc_id, then in some fixed
    order; ``rank`` counts them from 1 and is null elsewhere. A null or empty text has no words and a weight of 0; rows that repeat a doc_id are
    drawn each for itself; a row without a doc_id has no noise, hence a null score, and is never drawn or counted. An empty target
    leaves only the source's own frequencies to tell buckets apart; an empty ``docs`` gives an empty table. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch()
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = scratch.table(weigh(docs, gain, most).withColumn("score", F.col("weight") + noise), "resample-scores")
    fit = (F.col("n_words") >= least) & F.col("score").isNotNull()
    drawn = scored.where(fit).count() * percent // 100
    placed = global_index(scored.where(fit).withColumn("_down", -F.col("score")), "_down", "doc_id", name="_at")
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1)
    out = placed.withColumn("rank", rank).drop("_down", "_at").unionByName(scored.where(~fit | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long")))
    out, _ = shared_table(out, "resampled")
    scratch.drop(spark)
    return out


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns; ``how`` as in ``resample``."""
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_drawn_id"], "left_semi")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL
), bw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL
), crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS step
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, step[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weight AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
