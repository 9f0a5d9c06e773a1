"""Multi-label scoring: confusion counts, micro / macro / weighted / per-sample
averages, per-class report (A2-A6, C15, J8).

Gold and predictions are joined by record id (J8), never by position.  The
confusion counts are one aggregate over ``(class_idx)`` of the exploded arrays;
Spark combines it map-side, so only classes x partitions rows are shuffled.
Division by zero gives 0, as with ``zero_division=0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.session import written

AVG_ROWS = ("micro avg", "macro avg", "weighted avg", "samples avg")


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def align(pred: DataFrame, gold: DataFrame, key: str, pred_col: str = "labels",
          gold_col: str = "y") -> DataFrame:
    """``(key, y, yhat)`` - gold and prediction arrays of the same record.

    A gold record without a prediction counts as predicted nothing; a prediction without
    gold is an error.
    """
    both = pred.select(key, F.col(pred_col).alias("yhat")) \
        .join(gold.select(key, F.col(gold_col).alias("y")), key, "full_outer")
    stray = F.raise_error(F.concat(F.lit("prediction without gold: "), F.col(key).cast("string")))
    y = F.when(F.col("y").isNull(), stray.cast(both.schema["y"].dataType)).otherwise(F.col("y"))
    nothing = F.transform("y", lambda v: F.lit(0))
    return both.select(key, y.alias("y"), F.coalesce("yhat", nothing).alias("yhat"))


def confusion(aligned: DataFrame) -> DataFrame:
    """A2: ``(class_idx, tp, fp, fn, support, predicted)`` per class."""
    z = F.arrays_zip(F.col("y").alias("a"), F.col("yhat").alias("b"))
    ex = aligned.select(F.posexplode(z).alias("class_idx", "z")) \
        .select(F.col("class_idx").cast("int"), F.col("z.a").cast("long").alias("a"),
                F.col("z.b").cast("long").alias("b"))
    return ex.groupBy("class_idx").agg(
        F.sum(F.col("a") * F.col("b")).alias("tp"),
        F.sum((F.lit(1) - F.col("a")) * F.col("b")).alias("fp"),
        F.sum(F.col("a") * (F.lit(1) - F.col("b"))).alias("fn"),
        F.sum("a").alias("support"),
        F.sum("b").alias("predicted"))


def _class_scores(conf: DataFrame) -> list[Column]:
    return [_div(F.col("tp"), F.col("predicted")).alias("precision"),
            _div(F.col("tp"), F.col("support")).alias("recall"),
            _div(F.lit(2.0) * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1")]


def per_class(conf: DataFrame) -> DataFrame:
    """``(class_idx, precision, recall, f1, support)``."""
    return conf.select("class_idx", *_class_scores(conf), "support")


def micro_macro(conf: DataFrame) -> DataFrame:
    """A3 + A4: one row with the six scores of the reference's metric bundle."""
    pc = conf.select("tp", "predicted", "support", *_class_scores(conf))
    agg = pc.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("pred"),
                 F.sum("support").alias("true"),
                 F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                 F.avg("f1").alias("macro_f1"))
    return agg.select(
        _div(F.lit(2.0) * F.col("tp"), F.col("true") + F.col("pred")).alias("micro_f1"),
        "macro_f1",
        _div(F.col("tp").cast("double"), F.col("pred")).alias("micro_precision"),
        _div(F.col("tp").cast("double"), F.col("true")).alias("micro_recall"),
        "macro_precision", "macro_recall")


def per_sample_average(aligned: DataFrame) -> DataFrame:
    """``(precision, recall, f1)`` averaged over records (``samples avg``)."""
    tp = F.aggregate(F.zip_with("y", "yhat", lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
    t = F.aggregate("y", F.lit(0), lambda s, x: s + x)
    p = F.aggregate("yhat", F.lit(0), lambda s, x: s + x)
    rows = aligned.select(tp.alias("tp"), t.alias("t"), p.alias("p"))
    return rows.agg(F.avg(_div(F.col("tp").cast("double"), F.col("p"))).alias("precision"),
                    F.avg(_div(F.col("tp").cast("double"), F.col("t"))).alias("recall"),
                    F.avg(_div(F.lit(2.0) * F.col("tp"), F.col("t") + F.col("p"))).alias("f1"))


def _confusion_and_samples(aligned: DataFrame) -> DataFrame:
    """The confusion table with the per-record sums of the ``samples avg`` row in one
    aggregate: a record's own scores ride on its first class."""
    both = F.aggregate(F.zip_with("y", "yhat", lambda a, b: a * b), F.lit(0), lambda s, x: s + x).cast("double")
    true = F.aggregate("y", F.lit(0), lambda s, x: s + x)
    said = F.aggregate("yhat", F.lit(0), lambda s, x: s + x)
    z = F.arrays_zip(F.col("y").alias("a"), F.col("yhat").alias("b"))
    ex = aligned.select(_div(both, said).alias("sp"), _div(both, true).alias("sr"), _div(F.lit(2.0) * both, true + said).alias("sf"),
                        F.posexplode(z).alias("class_idx", "z"))
    first = lambda c: F.sum(F.when(F.col("class_idx") == 0, F.col(c)))
    a, b = F.col("z.a").cast("long"), F.col("z.b").cast("long")
    return ex.groupBy(F.col("class_idx").cast("int").alias("class_idx")).agg(
        F.sum(a * b).alias("tp"), F.sum((F.lit(1) - a) * b).alias("fp"), F.sum(a * (F.lit(1) - b)).alias("fn"),
        F.sum(a).alias("support"), F.sum(b).alias("predicted"), first("sp").alias("sp"), first("sr").alias("sr"),
        first("sf").alias("sf"), F.count(F.when(F.col("class_idx") == 0, 1)).alias("records"))


def classification_report(aligned: DataFrame, class_names: DataFrame | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class plus the four
    average rows; ``class_names`` is ``(class_idx, class)``.  The records are read once."""
    # one row per class, written: the per-class rows and the average rows read it
    conf = written(_confusion_and_samples(aligned), "confusion")
    pc = per_class(conf)
    if class_names is not None:
        pc = pc.join(class_names, "class_idx", "left") \
            .withColumn("label", F.coalesce("class", F.col("class_idx").cast("string")))
    else:
        pc = pc.withColumn("label", F.col("class_idx").cast("string"))
    rows = pc.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    support = F.sum("support").cast("long").alias("support")
    scores = per_class(conf)
    weighted = lambda c: _div(F.sum(F.col("support") * F.col(c)), F.sum("support")).alias(c)
    sample = lambda c, out: _div(F.sum(c), F.sum("records")).alias(out)
    total = lambda c: F.sum(c).cast("double")
    averages = [
        conf.agg(F.lit("micro avg").alias("label"), _div(total("tp"), F.sum("predicted")).alias("precision"),
                 _div(total("tp"), F.sum("support")).alias("recall"),
                 _div(F.lit(2.0) * total("tp"), F.sum("support") + F.sum("predicted")).alias("f1"), support),
        scores.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                   F.avg("f1").alias("f1"), support),
        scores.agg(F.lit("weighted avg").alias("label"), weighted("precision"), weighted("recall"), weighted("f1"), support),
        conf.agg(F.lit("samples avg").alias("label"), sample("sp", "precision"), sample("sr", "recall"), sample("sf", "f1"), support)]
    for row in averages:
        rows = rows.unionByName(row)
    return rows


def evaluate(pred: DataFrame, gold: DataFrame, key: str, pred_col: str = "labels",
             gold_col: str = "y") -> DataFrame:
    """The metric bundle of a decoded split."""
    return micro_macro(confusion(align(pred, gold, key, pred_col, gold_col)))


def per_label_f1(conf: DataFrame, digits: int = 5) -> DataFrame:
    """A5: ``(class_idx, f1)`` rounded to 5 digits."""
    return per_class(conf).select("class_idx", F.round("f1", digits).alias("f1"))
