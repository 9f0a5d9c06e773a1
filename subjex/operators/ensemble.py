"""Logit ensemble, calibration and scoring from stored logits.

Logits arrive as the long table ``(model_id, id, class_idx, logit)`` - the output
of any number of fine-tuned models (E4).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.functions.vectors import sigmoid
from subjex.operators.decode import apply_thresholds_or_topk, threshold_list
from subjex.operators.metrics import align, confusion, micro_macro, per_label_f1
from subjex.operators.thresholds import fit_thresholds_grid, long_probs

# Fixed value: digits of the probabilities in the prediction records.
PROB_DIGITS = 6
METRIC_DIGITS = 5


def ensemble_logits(logits: DataFrame, key: str = "id") -> DataFrame:
    """``(key, class_idx, logit, prob)`` - mean logit over all models, then sigmoid.

    Every model of the table must give a logit for each (record, class) that any model
    scores; a missing one is an error, not a smaller average.
    """
    n = logits.agg(F.count_distinct("model_id")).first()[0]
    per = logits.groupBy(key, "class_idx").agg(
        F.avg(F.col("logit").cast("double")).alias("logit"), F.count_distinct("model_id").alias("_n"))
    gap = F.raise_error(F.concat(F.lit("missing logit of a model: record "), F.col(key).cast("string"))).cast("double")
    return per.select(key, "class_idx", F.when(F.col("_n") == n, F.col("logit")).otherwise(gap).alias("logit")) \
        .withColumn("prob", sigmoid("logit"))


def prob_arrays(long_df: DataFrame, key: str = "id", value: str = "prob",
                out: str = "probs", n_classes: int | None = None) -> DataFrame:
    """``(key, probs ARRAY<DOUBLE>)``: the value of class ``i`` at position ``i``.

    ``n_classes`` defaults to the largest index plus one; a record that lacks a class is
    an error.  One group per record, bounded by the class count.
    """
    if n_classes is None:
        n_classes = int((long_df.agg(F.max("class_idx")).first()[0] or 0)) + 1
    per = long_df.groupBy(key).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("class_idx").cast("int"), F.col(value).cast("double")))).alias("_m"))
    gap = F.raise_error(F.concat(F.lit("missing class: record "), F.col(key).cast("string"))).cast("double")
    at = lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), gap)
    return per.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), at).alias(out))


@dataclass
class EnsembleResult:
    predictions: DataFrame  # (id, labels, probs)  - S14 records
    thresholds: DataFrame   # (class_idx, threshold)
    metrics: DataFrame      # (macro_f1, micro_f1, avg_threshold)
    per_label: DataFrame    # (class_idx, f1)


def score_ensemble(logits: DataFrame, calib_logits: DataFrame, calib_gold: DataFrame,
                   gold: DataFrame | None = None, key: str = "id", topk: int = 0) -> EnsembleResult:
    """Calibrate grid thresholds on one split, decode another with
    thresholds united with top-k, write rounded probabilities, and score.

    ``gold``/``calib_gold`` are ``(key, y ARRAY<INT>)``.
    """
    calib = prob_arrays(ensemble_logits(calib_logits, key), key)
    thr = fit_thresholds_grid(long_probs(calib.join(calib_gold, key), key, "probs", "y"))
    thr_list = threshold_list(thr)
    avg_thr = round(sum(thr_list) / len(thr_list), METRIC_DIGITS) if thr_list else None
    probs = prob_arrays(ensemble_logits(logits, key), key)
    pred = probs.select(key, apply_thresholds_or_topk("probs", thr_list, topk).alias("labels"),
                        F.transform("probs", lambda p: F.round(p, PROB_DIGITS)).alias("probs"))
    if gold is None:
        return EnsembleResult(pred, thr, None, None)
    conf = confusion(align(pred, gold, key))
    metrics = micro_macro(conf).select(
        F.round("macro_f1", METRIC_DIGITS).alias("macro_f1"),
        F.round("micro_f1", METRIC_DIGITS).alias("micro_f1"),
        F.lit(avg_thr).cast("double").alias("avg_threshold"))
    return EnsembleResult(pred, thr, metrics, per_label_f1(conf, METRIC_DIGITS))
