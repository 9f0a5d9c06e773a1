"""Equi joins that stay balanced when one key holds a large share of the rows.

A key with more than ``rows_per_salt`` rows on the large side is *hot*: its rows
get a salt in ``[0, n_salt)`` from a hash of the row, and the other side's rows
of that key are repeated once per salt, so the key's work is spread over
``n_salt`` tasks.  ``rows_per_salt`` is raised to the total over ``MAX_HOT_KEYS`` rows, so
the hot-key table has at most ``MAX_HOT_KEYS`` rows whatever the data - a proven bound -
and is broadcast to both sides.  Cold keys keep salt 0 and are joined as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
MAX_HOT_KEYS = 10_000


def hot_keys(key_rows: DataFrame, on: list[str], count_col: str = "n",
             rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(on..., _ns)`` for keys with more than ``rows_per_salt`` rows."""
    total = key_rows.agg(F.sum(count_col)).first()[0] or 0
    rows_per_salt = max(rows_per_salt, -(-total // MAX_HOT_KEYS))
    return (key_rows.where(F.col(count_col) > rows_per_salt)
                    .select(*on, F.ceil(F.col(count_col) / F.lit(rows_per_salt)).cast("int").alias("_ns")))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame,
                how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small`` on ``on``; hot keys of ``big`` are split by salt."""
    hb = F.broadcast(hot)
    b = (big.join(hb, on, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]),
                                        F.coalesce(F.col("_ns"), F.lit(1))).cast("int"))
            .drop("_ns"))
    s = (small.join(hb, on, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)) - 1)))
              .drop("_ns"))
    return b.join(s, on + ["_salt"], how).drop("_salt")
