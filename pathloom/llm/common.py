"""Helpers shared by the training-data operators: table access, shared intermediate tables, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch handed to Python; texts are a few kB, so a batch stays at a few MB.
ROWS_PER_BATCH = 1000


#: Characters of the labelled texts that a model is fitted on, at most.
SAMPLE_CHARS = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back: the lineage is cut, lost executors lose nothing.

    The table goes when the application ends, if it isn't dropped before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that no live DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a written table above which no join with it is a broadcast.
BROADCAST_BYTES = 1 << 20


def exchanged(df: DataFrame, path: str) -> DataFrame:
    """``df``, the table at ``path``, whose joins are by exchanges if its files hold more than BROADCAST_BYTES.

    Spark would judge by its files alone whether it fits the driver; ids and sizes take a few bytes there and thirty or more in a
    broadcast's hash table, so what the driver holds would grow with the input.
    """
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.hint("merge") if held > BROADCAST_BYTES else df


class Scratch:
    """Shared tables of one operator, dropped together when what was made of them is written elsewhere."""

    def __init__(self, plain_joins: bool = False):
        self.paths: list[str] = []
        self.plain_joins = plain_joins

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = shared_table(df, tag)
        self.paths.append(path)
        return exchanged(out, path) if self.plain_joins else out

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            drop_path(spark, path)


def is_held_out(doc_id: Column) -> Column:
    """The fixed evaluation fold: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts outside the evaluation fold, picked by a hash of the id.

    Only the bounded list of ids is broadcast; rows with a null label, id or text are left out. Texts reach the driver
    partition by partition, until they hold ``most_chars`` characters.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows, chars = [], 0
    for r in texts_of(docs, picked).orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(8).toLocalIterator():
        chars += len(r["text"])
        if rows and chars > most_chars:
            break
        rows.append(r)
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """``picked(doc_id, ...)``, a small table of distinct ids, with one text of each: the least, where an id is repeated."""
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id", "left_semi")
    return own.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(picked), "doc_id")


#: 64-bit words of a bit table: what a broadcast of one holds at most, whatever the input.
BIT_WORDS = 1 << 19


def bit_place(key: Column, words: int = BIT_WORDS) -> tuple[Column, Column]:
    """Word and bit of a hash of ``key`` in a table of ``words`` 64-bit words."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(words)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def perhaps_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``ids``'s column of that name: all that are, and few others.

    A bit table of the ids' hashes is broadcast: BIT_WORDS rows at most, filled map-side first. It keeps most other rows out of a join's
    shuffle until the ids outnumber its bits; beyond that it passes all.
    """
    word, bit = bit_place(F.col(key))
    table_ = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = df.join(F.broadcast(table_), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi")
    return found


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few of their texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with small slices: ``fn`` takes at most ROWS_PER_BATCH rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, fn: Callable[[list[str | None]], tuple[list[str | None] | None, list[bool] | None]]) -> DataFrame:
    """Rewrites or filters whole rows by their ``text``: ``fn`` returns new texts, and which rows stay (None: as they
    were). All columns pass through, whatever their names."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, keep = fn(batch.column(at).to_pylist())
        if texts is not None:
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs.withColumn("text", F.col("text").cast("string")), run, docs.withColumn("text", F.col("text").cast("string")).schema)


def chunks(texts: list[str | None], most_chars: int = 150_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most_chars`` characters, or one longer text alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and total + n > most_chars:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)
