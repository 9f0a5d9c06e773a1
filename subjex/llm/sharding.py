"""Hilbert-curve sharding: documents near in several metadata dimensions share files.

Each dimension is quantised at quantiles, approximate ones of numbers and exact ones of whole
strings (at most 2**bits cut points a dimension reach the driver), the cells are numbered along a Hilbert curve, rows are
numbered along the curve by distributed counts, and the order is cut into runs of equal
row counts.  A cell that holds most rows is numbered in hash buckets, never in one task.

Defined results: a null text counts no bytes; a null dimension is below all values; rows
equal in id, size and text checksum take neighbouring places; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.llm.common import fresh, nested, ranked
from subjex.session import written

BITS = 5
SHARDS = 40


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x dims), Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[i] ^= swap
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap if i else x[0])
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def string_cuts(rows: DataFrame, column: str, levels: int) -> list[str]:
    """Whole strings at the quantiles i / ``levels`` of a column: distinct values are counted,
    sorted over the cluster, and their counts summed within each range and over the ranges."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "string-counts")
    before, total = {}, 0
    for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a range
        before[r["part"]] = total
        total += r["n"]
    if not total:
        return []
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "part int, offset long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("offset")
    placed = ranges.join(F.broadcast(offsets), "part").withColumn("upto", upto)
    crosses = F.expr(f"(upto - n) * {levels} div {total} < upto * {levels} div {total}")
    # at most one value a quantile; the first one separates nothing
    return sorted((r["v"] for r in placed.where(crosses).select("v").collect()), key=lambda v: v.encode())


def with_cells(rows: DataFrame, dims: list[str], bits: int = BITS, out: str = "cell") -> DataFrame:
    """Add ``out``: the Hilbert index of the row's quantised ``dims``.  Strings are compared
    whole, in the order of their bytes."""
    kinds = dict(rows.dtypes)
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    number = lambda d: F.col(d).cast("double")
    numeric = [d for d in dims if kinds[d] != "string"]
    found = rows.agg(*[F.percentile_approx(number(d), points).alias(f"q{i}") for i, d in enumerate(numeric)]).first() if numeric else ()
    cuts = {d: sorted(set(q or [])) for d, q in zip(numeric, found)}
    cuts |= {d: string_cuts(rows, d, 1 << bits)[-len(points):] for d in dims if kinds[d] == "string"}

    def level(d):
        if not cuts[d]:
            return F.lit(0)
        value = F.col(d) if kinds[d] == "string" else number(d)
        over = F.filter(F.array(*[F.lit(s) for s in cuts[d]]), lambda s: value >= s)
        return F.when(value.isNull(), 0).otherwise(F.size(over))

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy() for c in cols], axis=1), bits))
    return rows.withColumn(out, index(*[level(d) for d in dims]))


def _positions(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``rows`` (a written table with ``cell``) with ``shard`` and ``slot``: runs of the curve of
    equal row counts, rows of a cell by ``order``."""
    counts = rows.groupBy("cell").count()  # at most 2 ** (bits * dims) rows
    total = rows.count()
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("cell").alias("_cell"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    along = ranked(rows, "cell", order).join(F.broadcast(starts), F.col("cell") == F.col("_cell"))
    placed = along.withColumn("position", F.col("_start") + F.col("rank")).withColumn(
        "shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    # the first position p of shard s is the least with p * shards >= s * total
    return placed.withColumn("slot", F.expr(f"position - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))


def place(docs: DataFrame, dims: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text, ``dims``).

    Row counts of shards are at most one apart; ``slot`` numbers a shard's rows from 0.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *[F.col(d).alias(f"dim{i}") for i, d in enumerate(dims)])
    rows = written(rows, "shard-keys")
    names = [f"dim{i}" for i in range(len(dims))]
    rows = written(with_cells(rows, names, bits).drop(*names), "shard-cells")
    return _positions(rows, ["doc_id", "text_crc32", "size"], shards) \
        .select("doc_id", "size", "text_crc32", "shard", "slot", "cell")


def write_sorted(docs: DataFrame, path: str, dims: list[str], shards: int, bits: int = BITS) -> None:
    """Write ``docs`` in ``shards`` folders ``shard=0`` .. along the curve, so that the minima and
    maxima of every dimension prune files.  The cut is by rows: a cell that holds most of them
    is spread over several shards, also where all its dimensions are equal."""
    rows = nested(docs, **{f"dim{i}": F.col(d) for i, d in enumerate(dims)})
    celled = with_cells(rows, [f"dim{i}" for i in range(len(dims))], bits).select("row", "cell", F.xxhash64("row").alias("h"))
    placed = _positions(written(celled, "rows-by-cell"), ["h"], shards)
    placed.select("shard", "cell", "row").repartition(shards, "shard").sortWithinPartitions("shard", "cell") \
        .select(F.col("shard").alias(fresh("shard", docs.columns)), "row.*") \
        .write.partitionBy(fresh("shard", docs.columns)).parquet(path)
