"""Nearest-neighbour search over vector columns (V1 - V5).

``exact_top_k`` is a blocked similarity join.  Both sides are cut into blocks of
bounded size inside each group (one group for exact search, one group per
inverted-file cell for approximate search).  A query block meets every item
block of its group through a co-grouped equi join on ``(group, item block,
query block)``; each meeting multiplies two small matrices in numpy and emits
only the best ``k`` items per query (ties cut by id).  No pair rows are
materialised, no side is collected, and a hot group is split into as many
blocks as its size needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjex.operators.blocks import near_best, top_k_tables  # noqa: F401  (near_best: for cells)
from subjex.operators.ranking import RANK_DECIMALS, top_k
from subjex.functions.vectors import NORM_EPS
from subjex.session import ship_package

# Rows per block.  Every item block meets every query block of its group, so an
# item row is shuffled once per query block and a query row once per item
# block; queries usually outnumber items, hence the larger query blocks.  A
# group's Arrow tables hold one block of each side; the product is computed
# blocks.Q_CHUNK query rows at a time (Q_CHUNK x ITEM_BLOCK doubles, 8 MB).  Exact
# search over all pairs is inherently |Q| x |I|; the inverted-file search (V3) is the
# path for large vocabularies.
QUERY_BLOCK = 16384
ITEM_BLOCK = 8192
# Few items make smaller query blocks: a block of this many rows an item (LEAST_BLOCK rows at
# least) still moves far more queries than copies of items, and workers hold less.
ROWS_PER_ITEM = 16
LEAST_BLOCK = 4096
# Rows a centre that the starting centres of product quantisation are chosen from; every
# row takes part in the fit itself.
START_ROWS = 16


def _block_plan(df: DataFrame, group: str, block_rows: int, name: str) -> DataFrame:
    """``(group, n_<name>)``: number of blocks per group.  One row per group, and
    the number of groups is a parameter (1 or the cell count), so it is broadcast."""
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("_cnt"))
              .select(group, F.greatest(F.lit(1), F.ceil(F.col("_cnt") / F.lit(block_rows)))
                      .cast("int").alias(f"n_{name}")))


def _query_rows(n_items: int, query_block: int) -> int:
    """Rows of a query block that meets ``n_items`` items."""
    return min(query_block, max(LEAST_BLOCK, ROWS_PER_ITEM * n_items))


def _topk_block_fn(k: int, normalize: bool, qk: str, ik: str, book: "PqCodebook | None" = None):
    """``top_k_tables`` over pandas frames."""
    tables = top_k_tables(k, normalize, qk, ik, book)

    def fn(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        return tables(*(pa.Table.from_pandas(x, preserve_index=False) for x in (q, it))).to_pandas()
    return fn


def exact_top_k(queries: DataFrame, q_key: str, q_vec: str,
                items: DataFrame, i_key: str, i_vec: str, k: int,
                group: str | None = None, normalize: bool = True,
                query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK,
                rank_col: str = "rank", book: "PqCodebook | None" = None) -> DataFrame:
    """V1: the ``k`` items with the highest cosine per query, exact.

    ``group``: a column present on both sides; queries only meet items of the same
    group value (inverted-file cells, V3).  Output ``(q_key, i_key, score, rank)``.
    """
    ship_package(queries.sparkSession)
    if q_key == i_key:
        raise ValueError("query and item keys need different names")
    if group is None:
        # one group: the block counts are two scalar counts, used as literals
        g = "_g"
        q = queries.select(F.lit(0).alias(g), F.col(q_key), F.col(q_vec).alias("_qv"))
        it = items.select(F.lit(0).alias(g), F.col(i_key), F.col(i_vec).alias("_iv"))
        sizes = (q.select(F.lit(0).alias("_side")).unionByName(it.select(F.lit(1).alias("_side")))
                  .agg(F.sum((F.col("_side") == 0).cast("long")).alias("nq"),
                       F.sum((F.col("_side") == 1).cast("long")).alias("ni")).first())
        query_block = _query_rows(int(sizes["ni"] or 0), query_block)
        n_qb = F.lit(max(1, -(-int(sizes["nq"] or 0) // query_block)))
        n_ib = F.lit(max(1, -(-int(sizes["ni"] or 0) // item_block)))
        qj, ij = q, it
    else:
        # one row per group (the cell count is a parameter): broadcast, equi join
        g = group
        q = queries.select(g, F.col(q_key), F.col(q_vec).alias("_qv"))
        it = items.select(g, F.col(i_key), F.col(i_vec).alias("_iv"))
        plan = F.broadcast(_block_plan(q, g, query_block, "qb")
                           .join(_block_plan(it, g, item_block, "ib"), g, "inner"))
        qj, ij = q.join(plan, g), it.join(plan, g)
        n_qb, n_ib = F.col("n_qb"), F.col("n_ib")

    qb = (qj.withColumn("_qb", F.pmod(F.xxhash64(F.col(q_key)), n_qb).cast("int"))
            .withColumn("_ib", F.explode(F.sequence(F.lit(0), n_ib - 1)))
            .select(g, "_ib", "_qb", q_key, "_qv"))
    ib = (ij.withColumn("_ib", F.pmod(F.xxhash64(F.col(i_key)), n_ib).cast("int"))
            .withColumn("_qb", F.explode(F.sequence(F.lit(0), n_qb - 1)))
            .select(g, "_ib", "_qb", i_key, "_iv"))

    schema = T.StructType([queries.schema[q_key], items.schema[i_key],
                           T.StructField("score", T.DoubleType(), False)])
    fn = top_k_tables(k, normalize, q_key, i_key, book)
    partial = (qb.groupBy(g, "_ib", "_qb")
                 .cogroup(ib.groupBy(g, "_ib", "_qb"))
                 .applyInArrow(fn, schema))
    return top_k(partial, q_key, i_key, "score", k, rank_col=rank_col)


# ---------------------------------------------------------------------------
# Inverted file (V2, V3)

@dataclass
class IvfIndex:
    centroids: DataFrame   # (cell INT, centroid ARRAY<DOUBLE>)
    assignments: DataFrame  # (<item key>, cell INT, <vector>)
    n_cells: int
    i_key: str
    i_vec: str
    centers: np.ndarray | None = None  # n_cells x dim, bounded by the cell parameter


def build_ivf(items: DataFrame, i_key: str, i_vec: str, n_cells: int,
              seed: int = 42, max_iter: int = 20) -> IvfIndex:
    """V2: coarse cells by k-means over the L2-normalised item vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from subjex.functions.vectors import l2_normalize

    data = items.select(i_key, i_vec, array_to_vector(l2_normalize(i_vec)).alias("_fv"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_fv",
                   predictionCol="cell").fit(data)
    centers = model.clusterCenters()  # k x dim, bounded by the cell parameter
    spark = items.sparkSession
    centroids = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers)],
        "cell INT, centroid ARRAY<DOUBLE>")
    assignments = model.transform(data).select(i_key, F.col("cell").cast("int"), i_vec)
    return IvfIndex(centroids, assignments, len(centers), i_key, i_vec, np.array(centers))


def nearest_cells(q_vec: str, centers: np.ndarray, nprobe: int, normalize: bool = True):
    """The ``nprobe`` cells whose centroids are closest (cosine) to each query, as
    an ``ARRAY<INT>``; the centroid matrix ships with the function (its size is
    the cell count times the dimension, a parameter)."""
    c = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), NORM_EPS)
    n = min(nprobe, len(c))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probe(vecs: pd.Series) -> pd.Series:
        x = np.vstack(vecs.to_numpy()).astype(np.float64)
        if normalize:
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)
        sims = np.round(x @ c.T, RANK_DECIMALS)
        # best first, lower cell index on ties
        order = np.lexsort((np.broadcast_to(np.arange(len(c)), sims.shape), -sims), axis=1)
        return pd.Series(list(order[:, :n].astype(np.int32)))

    return probe(F.col(q_vec))


def ivf_top_k(queries: DataFrame, q_key: str, q_vec: str, index: IvfIndex, k: int,
              nprobe: int, normalize: bool = True) -> DataFrame:
    """V3: probe the ``nprobe`` nearest cells of each query, exact search inside them.

    With ``nprobe = n_cells`` the result equals ``exact_top_k``.
    """
    ship_package(queries.sparkSession)
    if index.centers is not None:
        # in-row probe selection: no join back to the queries
        probed = queries.select(q_key, q_vec, F.explode(
            nearest_cells(q_vec, index.centers, nprobe, normalize)).alias("cell"))
    else:
        probes = exact_top_k(queries.select(q_key, q_vec), q_key, q_vec,
                             index.centroids, "cell", "centroid", min(nprobe, index.n_cells),
                             normalize=normalize, rank_col="_probe")
        probed = probes.select(q_key, "cell").join(queries.select(q_key, q_vec), q_key)
    return exact_top_k(probed, q_key, q_vec, index.assignments, index.i_key, index.i_vec, k,
                       group="cell", normalize=normalize)


# ---------------------------------------------------------------------------
# Product quantisation (V4)

@dataclass
class PqCodebook:
    codebooks: np.ndarray  # (m, ksub, dsub) - bounded by ksub x dim
    m: int
    dsub: int


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each row."""
    if centers.shape[1] == 1:
        order = np.argsort(centers[:, 0], kind="stable")
        c = centers[order, 0]
        return order[np.searchsorted((c[1:] + c[:-1]) / 2, x[:, 0])]
    return ((centers ** 2).sum(axis=1) - 2.0 * (x @ centers.T)).argmin(axis=1)


def _spread_centers(rows: np.ndarray, m: int, ksub: int, seed: int) -> np.ndarray:
    """Starting centres ``(m, ksub, dsub)``: k-means++ over ``rows``, all sub-vectors at once;
    with fewer than ``ksub`` distinct values, centres repeat."""
    r = np.random.default_rng(seed)
    x = rows.reshape(len(rows), m, -1).transpose(1, 0, 2)
    part = np.arange(m)
    centers = [x[part, r.integers(0, len(rows), m)]]
    far = ((x - centers[0][:, None]) ** 2).sum(axis=2)
    for _ in range(1, ksub):
        mass = np.cumsum(far, axis=1)
        at = (mass <= r.random(m)[:, None] * mass[:, -1:]).sum(axis=1)
        centers.append(x[part, np.minimum(at, len(rows) - 1)])
        far = np.minimum(far, ((x - centers[-1][:, None]) ** 2).sum(axis=2))
    return np.stack(centers, axis=1)


def train_pq(items: DataFrame, i_vec: str, m: int, ksub: int, seed: int = 42,
             max_iter: int = 20, tol: float = 1e-4, normalize: bool = True) -> PqCodebook:
    """V4: one k-means per sub-vector of the L2-normalised item vectors (as they are with
    ``normalize=False``).

    All ``m`` fits advance together, one job over all rows an iteration; only sums and
    counts of ``m x ksub`` centres leave the tasks.  The starting centres come from
    ``START_ROWS`` rows a centre, the smallest by hash.
    """
    from subjex.functions.vectors import l2_normalize

    spark = items.sparkSession
    ship_package(spark)
    dim = len(items.select(i_vec).first()[0])
    if dim % m:
        raise ValueError(f"dimension {dim} is not a multiple of m={m}")
    dsub = dim // m
    vec = l2_normalize(i_vec) if normalize else F.col(i_vec).cast("array<double>")
    data = items.select(vec.alias("_v")).persist()

    def sums(books):
        def run(batches):
            total, count = np.zeros((m, ksub, dsub)), np.zeros((m, ksub))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m, dsub)
                for j in range(m):
                    code = _nearest(x[:, j], books[j])
                    count[j] += np.bincount(code, minlength=ksub)
                    for d in range(dsub):
                        total[j, :, d] += np.bincount(code, x[:, j, d], ksub)
            flat = np.concatenate([total.ravel(), count.ravel()])
            yield pa.RecordBatch.from_pydict({"sums": pa.array([flat.tobytes()], pa.binary())})
        return run

    try:
        start = data.orderBy(F.xxhash64("_v")).limit(START_ROWS * ksub).collect()  # bounded
        books = _spread_centers(np.array([r[0] for r in start]), m, ksub, seed)
        for _ in range(max_iter):
            flat = data.mapInArrow(sums(books), "sums binary").rdd \
                .map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
            total, count = flat[:books.size].reshape(books.shape), flat[books.size:].reshape(m, ksub, 1)
            moved = np.where(count > 0, total / np.maximum(count, 1), books)
            step, books = np.abs(moved - books).max(), moved
            if step <= tol:
                break
    finally:
        data.unpersist()
    return PqCodebook(books, m, dsub)


def pq_encode(items: DataFrame, i_vec: str, book: PqCodebook, out: str = "codes") -> DataFrame:
    """V4: ``codes ARRAY<INT>`` - the nearest centroid of each sub-vector."""
    cb = book.codebooks
    ship_package(items.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(vecs: pd.Series) -> pd.Series:
        x = np.vstack(vecs.to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)
        codes = np.empty((len(x), book.m), dtype=np.int32)
        for j in range(book.m):
            codes[:, j] = _nearest(x[:, j * book.dsub:(j + 1) * book.dsub], cb[j])
        return pd.Series(list(codes))

    return items.withColumn(out, encode(F.col(i_vec)))


def pq_decode(codes_col: str, book: PqCodebook):
    """The quantised vector of a code array (concatenated centroids)."""
    cb = book.codebooks

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(codes: pd.Series) -> pd.Series:
        c = np.vstack(codes.to_numpy())
        parts = [cb[j][c[:, j]] for j in range(book.m)]
        return pd.Series(list(np.hstack(parts)))

    return decode(F.col(codes_col))


def pq_top_k(queries: DataFrame, q_key: str, q_vec: str, coded: DataFrame, i_key: str,
             book: PqCodebook, k: int, group: str | None = None, codes: str = "codes") -> DataFrame:
    """V4 search: inner product of the exact (normalised) query with each item's
    quantised vector - the asymmetric distance - through the blocked top-k.  Only codes
    are shuffled; each block decodes its items' codes once."""
    from subjex.functions.vectors import l2_normalize

    ship_package(queries.sparkSession)
    q = queries.select(q_key, l2_normalize(q_vec).alias("_qn"), *([group] if group else []))
    cols = [F.col(i_key), F.col(codes).alias("_codes")] + ([F.col(group)] if group else [])
    return exact_top_k(q, q_key, "_qn", coded.select(*cols), i_key, "_codes", k, group=group,
                       normalize=False, book=book)
