"""Text encoders without model files (C1, E1): hashed TF-IDF and latent semantic vectors.

Both are fitted once and then encode documents, queries and labels alike, over whole texts.
A token falls into the bucket ``first 32 bits of its MD5 mod buckets``, a rule that other
engines have too.  ``TfIdfEncoder`` gives the normalised TF-IDF vector itself;
``LsaEncoder`` projects a sparse one with many buckets on its leading singular directions.

The singular directions come from a randomised range finder: a random matrix of
``buckets x (dim + OVERSAMPLE)`` is multiplied with the Gram matrix of all rows, one
distributed pass per power iteration in which tasks hand on sums of that size, and a last
pass solves the small problem that is left.  Nothing larger than that matrix reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import whitespace_tokens
from subjex.functions.vectors import NORM_EPS
from subjex.session import ship_package, written

#: Columns beyond ``dim`` in the range finder.
OVERSAMPLE = 10
#: Rows of a partial sum that travel together.
CHUNK_ROWS = 256
#: Partial sums of one chunk are added in at most this many groups first.
FAN_IN = 64
#: List values (tokens) that are worked on at a time; a longer row is a slice of its own.
SLAB = 1 << 16
#: Numbers (rows x buckets) of the TF-IDF vectors that are made and handed on at a time.
VECTORS = 1 << 18
#: Sparse rows that become a dense matrix (rows x buckets) for a product.
DENSE_ROWS = 128
#: Bound on the numbers of the projection matrix that ships with the encoder.
MAX_PROJECTION = 1 << 24


def term_buckets(tokens: Column, buckets: int) -> Column:
    """The bucket of each token: the first 32 bits of its MD5, mod ``buckets``."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
                                          % F.lit(buckets)).cast("int"))


def slices(column, values: int = SLAB, rows: int | None = None):
    """(first row, rows) of runs of a list column with at most ``values`` list values and ``rows``
    rows, one row at least: what a task holds does not depend on the rows of an Arrow batch or
    their lengths."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + values, "right")))
        # rows without values are bounded as well
        b = min(b, a + (rows or values), len(column))
        yield a, b - a
        a = b


def _entries(column, buckets: int):
    """(row, bucket, count) of a list column of buckets, by row and bucket; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    key, count = np.unique(row * buckets + column.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return key // buckets, key % buckets, count


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(matrix.ravel()))


def inverse_frequencies(tokens: DataFrame, buckets: int) -> np.ndarray:
    """ln((rows + 1) / (rows with the bucket + 1)) over ``tokens`` (b array<int>); ``buckets`` rows."""
    def run(batches):
        rows, found = 0, np.zeros(buckets, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for a, n in slices(batch.column(0)):
                found += np.bincount(_entries(batch.column(0).slice(a, n), buckets)[1], minlength=buckets)
        used = np.r_[np.flatnonzero(found), buckets]  # the last one counts the rows
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.r_[found[used[:-1]], rows])], ["b", "n"])
    table = tokens.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets + 1, np.int64)
    counts[table.column("b").to_numpy()] = table.column("n").to_numpy()
    return np.log((counts[-1] + 1) / (counts[:-1] + 1))


@dataclass
class TfIdfEncoder:
    """Term counts per bucket times inverse document frequency, L2-normalised (zero stays zero)."""

    idf: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.idf)

    @staticmethod
    def fit(df: DataFrame, text_col: str, dim: int = 256) -> "TfIdfEncoder":
        return TfIdfEncoder.of_buckets(df.select(term_buckets(whitespace_tokens(text_col), dim).alias("b")), dim)

    @staticmethod
    def of_buckets(tokens: DataFrame, dim: int) -> "TfIdfEncoder":
        """Fitted on the term buckets (b array<int>) of the texts."""
        ship_package(tokens.sparkSession)
        return TfIdfEncoder(inverse_frequencies(tokens, dim))

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        return df.withColumn(out, self.vector(term_buckets(whitespace_tokens(text_col), self.dim), df.sparkSession))

    def vector(self, buckets: Column, spark: SparkSession) -> Column:
        """The vector of a text's term buckets."""
        ship_package(spark)
        return F.arrow_udf(_tfidf(self.idf), "array<double>")(buckets)


def _tfidf(idf: np.ndarray):
    """Normalised TF-IDF vectors of a list column of buckets.  A batch of the column is answered by
    several smaller ones, so that its vectors are never held together."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for a, n in slices(column, rows=max(1, VECTORS // len(idf))):
                row, b, count = _entries(column.slice(a, n), len(idf))
                x = np.zeros((n, len(idf)))
                x[row, b] = count * idf[b]
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)
                yield _lists(x)
    return run


def _sparse(column, idf: np.ndarray, number: int):
    """Normalised TF-IDF entries of ``number`` rows: (row, bucket, value)."""
    row, b, count = _entries(column, len(idf))
    value = (1 + np.log(count)) * idf[b]
    norm = np.sqrt(np.bincount(row, value * value, number))
    return row, b, value / np.maximum(norm, NORM_EPS)[row]


def _dense(row, b, value, number: int, width: int):
    """(first row, rows, their dense matrix) of runs of ``DENSE_ROWS`` sparse rows; entries are
    sorted by row.  A product of dense runs is several times faster than sums of gathered rows."""
    edge = np.searchsorted(row, np.arange(0, number + DENSE_ROWS, DENSE_ROWS))
    for i, (start, end) in enumerate(zip(edge[:-1], edge[1:])):
        a = i * DENSE_ROWS
        x = np.zeros((min(DENSE_ROWS, number - a), width))
        x[row[start:end] - a, b[start:end]] = value[start:end]
        yield a, len(x), x


def _times(row, b, value, number: int, matrix: np.ndarray) -> np.ndarray:
    """The sparse rows times ``matrix``; entries are sorted by row."""
    out = np.empty((number, matrix.shape[1]))
    for a, n, x in _dense(row, b, value, number, len(matrix)):
        np.matmul(x, matrix, out=out[a:a + n])
    return out


def _gram_part(idf: np.ndarray, q: np.ndarray, small: bool):
    """Sums over the rows x of a task: x'(xq), or (xq)'(xq) when ``small``; as chunks of rows."""
    def run(batches):
        total = np.zeros((q.shape[1], q.shape[1]) if small else q.shape)
        for batch in batches:
            for i, n in slices(batch.column(0)):
                part = batch.column(0).slice(i, n)
                row, b, value = _sparse(part, idf, len(part))
                for _, _, x in _dense(row, b, value, len(part), len(q)):
                    z = x @ q
                    total += z.T @ z if small else x.T @ z
        yield chunked(total)
    return run


def chunked(total: np.ndarray, rows: int | None = None) -> pa.RecordBatch:
    """A task's matrix of sums as rows (chunk int, m binary)."""
    rows = rows or CHUNK_ROWS
    chunks = [total[i:i + rows] for i in range(0, len(total), rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())],
                                      ["chunk", "m"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_buffer()) for m in table.column("m"))
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices, added in two steps so that no group grows with all tasks."""
    salted = parts.withColumn("salt", F.spark_partition_id() % FAN_IN)
    some = salted.groupBy("chunk", "salt").applyInArrow(_add, "chunk int, m binary")
    rows = some.groupBy("chunk").applyInArrow(_add, "chunk int, m binary").collect()  # one matrix of fixed size
    return np.concatenate([np.frombuffer(r["m"]).reshape(-1, width) for r in sorted(rows, key=lambda r: r["chunk"])])


@dataclass
class LsaEncoder:
    """Latent semantic vectors: sublinear TF-IDF rows projected on ``projection`` (buckets x dim),
    L2-normalised; a text without a known bucket has a zero vector."""

    idf: np.ndarray
    projection: np.ndarray
    singular: np.ndarray

    @staticmethod
    def fit(df: DataFrame, text_col: str, dim: int = 64, buckets: int = 1 << 13, power: int = 2, seed: int = 42) -> "LsaEncoder":
        """Fit on all rows of ``df``: one pass for document frequencies, ``power + 2`` for the
        leading ``dim`` singular directions."""
        width = min(dim + OVERSAMPLE, buckets)
        if buckets * width > MAX_PROJECTION:
            raise ValueError("projection matrix too large to ship with the encoder")
        ship_package(df.sparkSession)
        tokens = written(df.select(term_buckets(whitespace_tokens(text_col), buckets).alias("b")), "term-buckets")
        idf = inverse_frequencies(tokens, buckets)
        q = np.random.default_rng(seed).standard_normal((buckets, width))
        for _ in range(power + 1):
            q = np.linalg.qr(summed(tokens.mapInArrow(_gram_part(idf, q, False), "chunk int, m binary"), width))[0]
        small = summed(tokens.mapInArrow(_gram_part(idf, q, True), "chunk int, m binary"), width)
        value, vector = np.linalg.eigh(small)
        best = np.argsort(-value)[:dim]
        return LsaEncoder(idf, q @ vector[:, best], np.sqrt(np.maximum(value[best], 0)))

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        ship_package(df.sparkSession)
        idf, projection = self.idf, self.projection

        @F.arrow_udf("array<float>")
        def encode(buckets: pa.Array) -> pa.Array:
            out = np.zeros((len(buckets), projection.shape[1]), np.float32)
            for a, n in slices(buckets):
                row, b, value = _sparse(buckets.slice(a, n), idf, n)
                x = _times(row, b, value, n, projection)
                out[a:a + n] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)
            return _lists(out)
        return df.withColumn(out, encode(term_buckets(whitespace_tokens(text_col), len(idf))))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(self.idf[i]), [float(x) for x in self.projection[i]]) for i in range(len(self.idf))]
        spark.createDataFrame(rows, "bucket INT, idf DOUBLE, projection ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/projection")
        spark.createDataFrame([([float(x) for x in self.singular],)], "singular ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/singular")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LsaEncoder":
        rows = spark.read.parquet(f"{path}/projection").orderBy("bucket").toArrow()
        projection = np.array(rows.column("projection").to_pylist())
        return LsaEncoder(rows.column("idf").to_numpy(), projection,
                          np.array(spark.read.parquet(f"{path}/singular").first()["singular"]))
