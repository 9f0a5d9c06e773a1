"""Per-key top-k by score (W1, W2) and the rank-to-list cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores are ranked after rounding to this many decimals, so that sums computed
# in a different order (another engine, another partitioning) rank the same way;
# equal rounded scores fall back to the item id.
RANK_DECIMALS = 9


def rank_key(score_col: str):
    return F.round(F.col(score_col), RANK_DECIMALS)


def top_k(df: DataFrame, key: str, item: str, score: str, k: int,
          rank_col: str = "rank", tier: str | None = None) -> DataFrame:
    """Keep the ``k`` best ``item`` per ``key``: score descending, item ascending
    (after ``tier`` descending, when given).

    ``row_number() <= k`` lets Catalyst insert a ``WindowGroupLimit`` before the
    exchange, so each map task ships at most ``k`` rows per key.
    """
    order = [rank_key(score).desc(), F.col(item).asc()]
    if tier:
        order.insert(0, F.col(tier).desc())
    w = Window.partitionBy(key).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k))


def ranked_list(df: DataFrame, key: str, item: str, rank_col: str = "rank",
                n: int | None = None, out_col: str = "gnd_pred") -> DataFrame:
    """Items of each key in rank order as an array, cut to ``n``.

    Input is already cut to top-k, so each group holds at most k rows.
    """
    if n is not None:
        df = df.filter(F.col(rank_col) <= n)
    return (df.groupBy(key)
              .agg(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"),
                                                        F.col(item).alias("v")))).alias("_l"))
              .select(key, F.col("_l.v").alias(out_col)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` records: order by the MD5 of ``seed:key`` (ties
    by key) and keep the first ``n`` (a top-n per task, then one merge)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)


def debug_limit(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` records by key, for debugging runs."""
    return df.orderBy(key).limit(n)
