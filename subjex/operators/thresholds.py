"""Per-class decision thresholds.

Input is the long form ``(class_idx, p, y)``: one row per record and class.

The exact fit needs, for every distinct probability of a class, how many
positives and negatives score at least that much - a descending prefix sum.  A
window over a whole class would put all records of that class in one task, so
the prefix sum is two-level: each class's probabilities are cut at approximate
quantiles, fixed once, so buckets hold similar numbers of rows whatever the
distribution (e.g. most probabilities near 0) - then per-bucket totals, a small
window over buckets for the offsets, and a window inside each (class, bucket).  The best threshold per
class is an aggregate (``max_by``), combined map-side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# F1 denominator guard of the exact fit, default threshold when a
# class has no candidate, and the grid of the calibration search.
F1_EPS = 1e-9
DEFAULT_THRESHOLD = 0.5
GRID = tuple(float(x) for x in np.linspace(0.05, 0.5, 10))
# Range buckets of the two-level prefix sum (0: twice the cluster's parallelism).
PREFIX_BUCKETS = 0


def long_probs(df: DataFrame, key: str, probs: str, gold: str) -> DataFrame:
    """``(key, class_idx, p, y)`` from aligned probability and gold arrays."""
    z = F.arrays_zip(F.col(probs).alias("p"), F.col(gold).alias("y"))
    return (df.select(key, F.posexplode(z).alias("class_idx", "z"))
              .select(key, F.col("class_idx").cast("int"), F.col("z.p").cast("double").alias("p"),
                      F.col("z.y").cast("int").alias("y")))


def _bucket_bounds(long_df: DataFrame, n: int) -> DataFrame:
    """``(class_idx, _bounds)``: up to ``n - 1`` approximate quantiles of a class's
    probabilities.

    Fixed once, as classes x n numbers on the driver (bounded by the class count): a row's
    bucket then depends on its probability alone, however often the plan computes it.
    """
    from subjex.operators.decode import MAX_CLASSES, bounded_collect
    points = [i / n for i in range(1, n)] or [0.5]
    per = long_df.groupBy("class_idx").agg(F.percentile_approx("p", points).alias("q"))
    rows = [(r["class_idx"], sorted(set(r["q"] or []))) for r in bounded_collect(per, MAX_CLASSES, "classes")]
    return long_df.sparkSession.createDataFrame(rows, "class_idx INT, _bounds ARRAY<DOUBLE>")


def pr_sweep(long_df: DataFrame, buckets: int = PREFIX_BUCKETS) -> DataFrame:
    """``(class_idx, threshold, tps, fps, pos_total, precision, recall, f1)``.

    One row per distinct probability of a class: predicting ``p >= threshold``
    gives ``tps`` true and ``fps`` false positives.  Precision is 0 when nothing
    is predicted; recall is 1 for a class without positives.
    """
    n = buckets or 2 * long_df.sparkSession.sparkContext.defaultParallelism
    vals = long_df.groupBy("class_idx", "p").agg(
        F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    vals = vals.join(F.broadcast(_bucket_bounds(long_df, n)), "class_idx") \
        .withColumn("b", F.size(F.filter("_bounds", lambda x: x > F.col("p")))).drop("_bounds")
    btot = vals.groupBy("class_idx", "b").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"))
    # range order: within a class, a higher bucket id holds lower probabilities
    wb = Window.partitionBy("class_idx").orderBy(F.col("b").asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy("class_idx")
    boff = btot.select("class_idx", "b",
                       F.coalesce(F.sum("bpos").over(wb), F.lit(0)).alias("opos"),
                       F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("oneg"),
                       F.sum("bpos").over(wall).alias("pos_total"))
    wv = Window.partitionBy("class_idx", "b").orderBy(F.col("p").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (vals.join(boff, ["class_idx", "b"])
               .select("class_idx", F.col("p").alias("threshold"), "pos_total",
                       (F.col("opos") + F.sum("pos").over(wv)).alias("tps"),
                       (F.col("oneg") + F.sum("neg").over(wv)).alias("fps")))
    prec = F.when(F.col("tps") + F.col("fps") > 0,
                  F.col("tps") / (F.col("tps") + F.col("fps"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("pos_total") > 0, F.col("tps") / F.col("pos_total")).otherwise(F.lit(1.0))
    out = cum.withColumn("precision", prec).withColumn("recall", rec)
    return out.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall")
                          / (F.col("precision") + F.col("recall") + F.lit(F1_EPS)))


def fit_thresholds_exact(long_df: DataFrame, classes: DataFrame | None = None,
                         no_positive: str = "lowest") -> DataFrame:
    """Per class the probability with the best F1; lowest on ties.

    A class without positives has F1 0 everywhere, so by default (as in the
    reference) its lowest probability wins and every record gets the class;
    ``no_positive="half"`` gives such a class 0.5 instead.  ``classes``
    (``class_idx``) adds classes without any record, at 0.5.
    """
    if no_positive not in ("lowest", "half"):
        raise ValueError("no_positive must be 'lowest' or 'half'")
    sweep = pr_sweep(long_df)
    best = sweep.groupBy("class_idx").agg(
        F.max_by("threshold", F.struct(F.col("f1"), (-F.col("threshold")).alias("nt")))
        .alias("threshold"), F.max("pos_total").alias("_pos"))
    if no_positive == "half":
        best = best.withColumn("threshold", F.when(F.col("_pos") == 0, F.lit(DEFAULT_THRESHOLD))
                               .otherwise(F.col("threshold")))
    best = best.drop("_pos")
    if classes is not None:
        best = classes.select("class_idx").join(best, "class_idx", "left") \
            .select("class_idx", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"))
    return best


def grid_f1(long_df: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """``(class_idx, i, threshold, f1)`` for each grid value, without replicating rows.

    Each row's grid position is the number of grid values it reaches (grid is
    ascending), so one aggregate per (class, position) gives every count.
    """
    g = F.array(*[F.lit(t) for t in grid])
    reach = F.size(F.filter(g, lambda t: F.col("p") >= t))
    per = (long_df.withColumn("reach", reach)
                  .groupBy("class_idx", "reach")
                  .agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg")))
    totals = per.groupBy("class_idx").agg(F.sum("pos").alias("pos_total"))
    # classes x |grid| rows: one per class and grid value, from the array in-row
    cls_grid = totals.select(F.col("class_idx").alias("cls"), "pos_total",
                             F.posexplode(g).alias("i0", "threshold")) \
        .withColumn("i", F.col("i0") + 1)
    joined = cls_grid.join(per, (cls_grid.cls == per.class_idx) & (per.reach >= cls_grid.i),
                           "left")
    counts = (joined.groupBy(F.col("cls").alias("class_idx"), "i", "threshold", "pos_total")
                    .agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"),
                         F.coalesce(F.sum("neg"), F.lit(0)).alias("fp")))
    den = F.col("pos_total") + F.col("tp") + F.col("fp")
    f1 = F.when(den > 0, F.lit(2.0) * F.col("tp") / den).otherwise(F.lit(0.0))
    return counts.select("class_idx", "i", "threshold", f1.alias("f1"))


def fit_thresholds_grid(long_df: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Per class the lowest grid value with the best F1 above 0, else 0.5."""
    best = grid_f1(long_df, grid).groupBy("class_idx").agg(
        F.max_by("threshold", F.struct(F.col("f1"), (-F.col("i")).alias("ni"))).alias("t"),
        F.max("f1").alias("best_f1"))
    return best.select("class_idx", F.when(F.col("best_f1") > 0, F.col("t"))
                       .otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def mean_threshold(thresholds: DataFrame) -> DataFrame:
    """The mean of the per-class thresholds."""
    return thresholds.agg(F.avg("threshold").alias("avg_threshold"))
