"""Embedding whitening: principal components of a table of vectors, scaled to unit variance.

Covariances are streamed: each partition updates its mean and its sum of centred outer products by one rank-one step a row (Welford, 1962),
partitions are merged by the parallel update formula (Chan et al., 1983) in MERGERS tasks first, so the driver gets MERGERS states of d x d
numbers, whatever the input. There the covariance is brought to tridiagonal form and solved by implicit symmetric QR steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import sliced, table

#: Tasks that merge the partitions' states.
MERGERS = 64
#: Largest entry of a vector, and an eigenvalue's least part of the largest one, for one that is not rounding.
LARGEST, LEAST_PART = 1 << 21, 1e-12
STATE = "slot int, n long, mean array<double>, products array<double>, total array<long>"


class Moments:
    """Count, mean and centred products of vectors, and their exact sum where they are integers."""

    def __init__(self, d: int):
        self.n, self.mean, self.products, self.total = 0, np.zeros(d), np.zeros((d, d)), np.zeros(d, np.int64)
        self._step = np.empty((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's step: the products grow by (x - old mean)(x - new mean)', a matrix of rank one."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        np.multiply(off[:, None], (off * ((self.n - 1) / self.n))[None], out=self._step)
        self.products += self._step

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray, total: np.ndarray) -> None:
        if n:
            off, both = mean - self.mean, self.n + n
            self.products += products + np.outer(off, off) * (self.n * n / both)
            self.mean += off * (n / both)
            self.total += total
            self.n = both

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, slot: int) -> pa.RecordBatch:
        lists = [pa.array([x.ravel()], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (self.mean, self.products, self.total)]
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([self.n], pa.int64()), *lists], ["slot", "n", "mean", "products", "total"])

    def merge_rows(self, rows: pa.RecordBatch | pa.Table) -> None:
        for r in rows.select(["n", "mean", "products", "total"]).to_pylist():
            d = len(self.mean)
            self.merge(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(d, d), np.array(r["total"], np.int64))


def moments(df: DataFrame, d: int, read) -> Moments:
    """The moments of all vectors of ``d`` entries that ``read`` (batch -> rows of a matrix) finds in ``df``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in sliced(batches):
            x = read(batch)
            for row in x:
                own.add(row)
            own.total += np.rint(x.sum(0)).astype(np.int64)
        if own.n:
            yield own.row(TaskContext.get().partitionId() % MERGERS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in sliced(batches, 16):
            own.merge_rows(batch)
        if own.n:
            yield own.row(0)

    out = Moments(d)
    out.merge_rows(df.mapInArrow(stream, STATE).repartition(MERGERS, "slot").mapInArrow(merge, STATE).toArrow())
    return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns, each with its largest entry positive.

    Householder reflections bring it to tridiagonal form, implicit QR steps with Wilkinson's shift to diagonal form.
    """
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            a[k + 1 :] -= np.outer(2 * v, v @ a[k + 1 :])
            a[:, k + 1 :] -= np.outer(a[:, k + 1 :] @ v, 2 * v)
            q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2 * v)
    diagonal, beside = a.diagonal().copy(), a.diagonal(-1).copy()
    q = q.T.copy()  # rows are turned below
    high = n - 1
    while high > 0:
        small = np.finfo(float).eps * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))
        beside[np.abs(beside) <= small] = 0
        while high > 0 and beside[high - 1] == 0:
            high -= 1
        if not high:
            break
        low = high - 1
        while low > 0 and beside[low - 1] != 0:
            low -= 1
        half = (diagonal[high - 1] - diagonal[high]) / 2
        shift = diagonal[high] - beside[high - 1] ** 2 / (half + np.copysign(np.hypot(half, beside[high - 1]), half))
        x, z = diagonal[low] - shift, beside[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                beside[k - 1] = r
            p, o, b = diagonal[k], diagonal[k + 1], beside[k]
            diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * b + s * s * o, s * s * p - 2 * c * s * b + c * c * o
            beside[k] = (c * c - s * s) * b + c * s * (o - p)
            if k < high - 1:
                x, z = beside[k], s * beside[k + 1]
                beside[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-diagonal, kind="stable")
    vectors = q[order].T
    return diagonal[order], vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1.0, 1.0)


def vectors_of(column: pa.Array, d: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vector can be used, and these vectors, every entry c as floor(scale * c) + shift."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    rows = np.flatnonzero(size == d)
    flat = column.take(pa.array(rows)).flatten()
    x = np.array(pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)).reshape(len(rows), d)
    fine = (np.abs(x) <= LARGEST).all(1)  # false for what is not a number, too
    return rows[fine], np.floor(scale * x[fine]) + shift


def exact_deviation(z: np.ndarray) -> list[int | None]:
    """Each row's sum of squares of integers; null where a long can't hold it."""
    if not z.size or int(np.abs(z).max()) ** 2 * z.shape[1] < 1 << 63:
        return (z * z).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in z.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length of vectors, the longer of equally frequent ones; 0 where there is none."""
    own = df.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return own["d"] if own else 0


def whiten(df: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``df(vec_id, embedding)`` -> ``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each usable vector and component.

    Vectors that are null, hold null or non-finite entries or ones beyond LARGEST, or differ in length from most, are dropped. Entries become
    floor(scale * c) + shift. ``deviation`` is the exact sum of (n x - S)^2 over the dimensions (null beyond a long), ``whitened`` the centred vector on the
    component over the root of its eigenvalue, ``explained`` that eigenvalue's part of the trace, ``identity_error`` how far the covariance
    of all whitened vectors is off the identity. Components without variance (LEAST_PART of the largest) are left out, so one vector, or copies of one,
    give no row, as does an empty table. Rows that repeat a vec_id, or have none, count as rows. Other columns are ignored.
    """
    rows = df.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = dimension(rows, "vector")
    own = moments(rows.select("vector"), d, lambda b: vectors_of(b.column(0), d, scale, shift)[1]) if d else Moments(0)
    values, basis = symmetric_qr(own.covariance()) if own.n else (np.zeros(0), np.zeros((d, 0)))
    kept = int((values[:components] > LEAST_PART * max(values.max(initial=0), 0)).sum())
    if not kept:
        return df.sparkSession.createDataFrame([], schema)
    n, total, onto, part = own.n, own.total, basis[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()

    def projected(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used, x = vectors_of(batch.column(at), d, scale, shift)
        z = n * x.astype(np.int64) - total
        return used, z, (z / n) @ onto

    check = moments(rows.select("vector"), kept, lambda b: projected(b, 0)[2])
    error = float(np.abs(check.covariance() - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            used, z, y = projected(batch, 1)
            m = len(used)
            deviation = pa.array(exact_deviation(z), pa.int64()).take(pa.array(np.repeat(np.arange(m), kept)))
            columns = [np.tile(np.arange(1, kept + 1, dtype=np.int32), m), np.full(m * kept, n, np.int64), deviation, y.ravel(), np.tile(part, m), np.full(m * kept, error)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(used, kept))), *map(pa.array, columns)], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op13``: the vectors that are used, and their exact deviations."""
    return op13(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


BASE_SQL = """
WITH fine AS (
  SELECT row_number() OVER () AS vec_no, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT + 100000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), entry AS (
  SELECT vec_no, vec_id, unnest(range(len(x))) AS i, unnest(x) AS x FROM fine
), total AS (
  SELECT i, count(*) AS n, sum(x) AS s FROM entry GROUP BY i
)
SELECT any_value(vec_id) AS vec_id, any_value(n) AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM entry JOIN total USING (i) GROUP BY vec_no
"""
