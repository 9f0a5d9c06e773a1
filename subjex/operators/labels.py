"""Label encoding against an ordered class list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.operators.decode import MAX_CLASSES, bounded_collect


def class_names(classes: DataFrame) -> list[str]:
    """The class list in order; bounded by the class count (checked)."""
    rows = bounded_collect(classes.select("class_idx", "class"), MAX_CLASSES, "classes")
    return [r["class"] for r in sorted(rows, key=lambda r: r["class_idx"])]


def multi_hot(df: DataFrame, codes: str, classes: list[str] | DataFrame, out: str = "y") -> DataFrame:
    """0/1 array in class order; unknown codes ignored, repeats count once.

    Row-local: the class list is an array literal (bounded by the class count).
    """
    names = class_names(classes) if isinstance(classes, DataFrame) else list(classes)
    arr = F.array(*[F.lit(c) for c in names])
    return df.withColumn(out, F.transform(arr, lambda c: F.array_contains(F.col(codes), c)
                                          .cast("int")))


def code_indices(df: DataFrame, key: str, codes: str, classes: DataFrame) -> DataFrame:
    """``(key, class_idx)`` - codes looked up in the class table (inner join:
    unknown codes dropped), one row per distinct class of a record."""
    ex = df.select(key, F.explode(codes).alias("class"))
    return ex.join(F.broadcast(classes.select("class", "class_idx")), "class") \
        .select(key, "class_idx").distinct()


def balanced_weights(y_long: DataFrame) -> DataFrame:
    """``(class_idx, w_pos, w_neg)`` = ``n / (2 n_pos)``, ``n / (2 n_neg)``."""
    agg = y_long.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))
    n, pos = F.col("n"), F.col("n_pos")
    return agg.select("class_idx",
                      F.when(pos > 0, n / (F.lit(2.0) * pos)).alias("w_pos"),
                      F.when(n - pos > 0, n / (F.lit(2.0) * (n - pos))).alias("w_neg"))
