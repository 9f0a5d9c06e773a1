"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_WS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, unchanged; null text has none (no regex)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), ASCII_WS, " " * len(ASCII_WS))
    return F.filter(F.split(spaced, " "), lambda w: w != F.lit(""))


def fresh(name: str, taken) -> str:
    """``name``, with underscores until no name in ``taken`` equals it (in any case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def nested(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, beside ``columns``: no name of the caller
    meets one used inside.  ``unnested`` is the way back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unnested(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """``columns`` out of ``row``, and ``new`` ones, which replace those of their name."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in new],
                     *[c.alias(n) for n, c in new.items()])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A higher-order function over a one-element array binds the value; a projected
    alias would be inlined into every lambda that mentions it.
    """
    return F.transform(F.array(value), body)[0]


def ranked(df: DataFrame, group: str, order: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """Add ``rank``: 0.. within ``group`` by (a hash bucket of ``order``, ``order``).

    No group meets in one task: a group is cut into buckets by a hash of the order
    columns, as many as its largest measured size asks for; bucket offsets are summed
    per group over the counts.  ``df`` must be cheap to read twice (a written table).
    Rows equal in all ``order`` columns get neighbouring ranks, in any order.
    """
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // rows_per_task))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = cut.groupBy(group, "_bucket").count()
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = cut.withColumn("_place", F.row_number().over(place) - 1)
    joined = numbered.join(starts, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("rank", F.col("_start") + F.col("_place")) \
        .drop("_bucket", "_g", "_b", "_start", "_place")
