"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; on one machine without it, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what was computed is computed once and outlives executors."""
    path = new_path(df.sparkSession, tag) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]]:
    """For each key in the first ``n`` columns of sorted batches its first row and its rows, slice by slice; read them before the next key."""

    def slices() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for b in batches:
            own, at = list(zip(*(b.column(i).to_pylist() for i in range(n)))), 0
            for k in range(1, len(own) + 1):
                if k == len(own) or own[k] != own[at]:
                    yield own[at], b.slice(at, k - at)
                    at = k

    for _, group in groupby(slices(), key=lambda s: s[0]):
        first = next(group)[1]
        yield first.slice(0, 1), chain([first], (s for _, s in group))


def gathered(found: Iterator[tuple[pa.RecordBatch, tuple]], n: int, columns: dict[str, pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of the keys in the first ``n`` columns of one-row batches, each with its tuple of further columns."""
    while own := list(islice(found, size)):
        keys = [pa.concat_arrays([name.column(i) for name, _ in own]) for i in range(n)]
        rest = [pa.array([row[i] for _, row in own], t) for i, t in enumerate(columns.values())]
        yield pa.RecordBatch.from_arrays(keys + rest, [*own[0][0].schema.names[:n], *columns])
