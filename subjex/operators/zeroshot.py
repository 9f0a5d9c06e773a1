"""Zero-shot domain tagging by similarity to class vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjex.functions.vectors import NORM_EPS
from subjex.operators.decode import MAX_CLASSES, bounded_collect
from subjex.operators.ranking import RANK_DECIMALS
from subjex.session import ship_package

# Fixed value: the reference's default number of classes set per record.
ZERO_SHOT_K = 5


def class_centroids(df: DataFrame, class_col: str, vec: str) -> DataFrame:
    """``(class_idx, embedding)``: per-class mean vector, component-wise.

    Stands in for encoding the class names when only vectors are given.  The
    aggregate is on ``(class, position)`` - classes x dims groups, combined map-side.
    """
    comp = (df.select(F.col(class_col).cast("int").alias("class_idx"),
                      F.posexplode(vec).alias("pos", "x"))
              .groupBy("class_idx", "pos").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return (comp.groupBy("class_idx")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c"))
                .select("class_idx", F.col("_c.x").alias("embedding")))


def zero_shot(records: DataFrame, key: str, vec: str, classes: DataFrame, n_classes: int,
              k: int = ZERO_SHOT_K) -> DataFrame:
    """``(key, labels ARRAY<INT>)`` - the ``k`` classes with the highest cosine set to 1, ties
    to the smaller class.  The class vectors (classes x dimensions) ship with the function, so
    records stay where they are."""
    ship_package(records.sparkSession)
    rows = sorted(bounded_collect(classes.select("class_idx", "embedding"), MAX_CLASSES, "classes"), key=lambda r: r["class_idx"])
    index = np.array([r["class_idx"] for r in rows], np.int64)
    matrix = np.array([r["embedding"] for r in rows], np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), NORM_EPS) if len(rows) else matrix

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tag(vecs: pd.Series) -> pd.Series:
        labels = np.zeros((len(vecs), n_classes), np.int32)
        if len(index):
            x = np.vstack(vecs.to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)
            best = np.argsort(-np.round(x @ matrix.T, RANK_DECIMALS), axis=1, kind="stable")[:, :k]
            np.put_along_axis(labels, index[best], 1, axis=1)
        return pd.Series(list(labels))
    return records.select(key, tag(F.col(vec)).alias("labels"))
