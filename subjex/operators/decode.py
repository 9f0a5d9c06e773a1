"""Decoding probability arrays into multi-hot label arrays.

All decoders are row-local higher-order-function expressions on an
``ARRAY<DOUBLE>`` column: no shuffle, and they run unchanged on streams.
Ties between equal probabilities go to the lower class index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("threshold", "threshold_ensure1", "global", "topk", "topk_minp")
# Upper bound on the class count for thresholds handed over as a literal array.
MAX_CLASSES = 100_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def threshold_list(thresholds: DataFrame) -> list[float]:
    """Per-class thresholds of a ``(class_idx, threshold)`` table, in class order.

    The table has one row per class, so what reaches the driver is bounded by
    the class list (checked).
    """
    rows = bounded_collect(thresholds.select("class_idx", "threshold"), MAX_CLASSES, "thresholds")
    return [float(r["threshold"]) for r in sorted(rows, key=lambda r: r["class_idx"])]


def bounded_collect(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table that is bounded by construction (one row per class), in
    one job; more than ``bound`` rows is an error, never a silent cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows")
    return rows


def thresholds_array(thresholds) -> Column:
    """Per-class thresholds (a sequence or a ``(class_idx, threshold)`` table) as
    an array literal."""
    if isinstance(thresholds, DataFrame):
        thresholds = threshold_list(thresholds)
    return F.array(*[F.lit(float(t)) for t in thresholds])


def apply_thresholds(probs, thresholds) -> Column:
    """``p >= t`` per class."""
    thr = thresholds if isinstance(thresholds, Column) else thresholds_array(thresholds)
    return F.zip_with(_c(probs), thr, lambda p, t: (p >= t).cast("int"))


def argmax(probs) -> Column:
    """Index of the first maximum (0-based)."""
    return (F.array_position(_c(probs), F.array_max(_c(probs))) - 1).cast("int")


def one_hot(n: Column, idx: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: (j == idx).cast("int"))


def _ensure_one(preds: Column, probs) -> Column:
    empty = F.aggregate(preds, F.lit(0), lambda a, x: a + x) == 0
    top1 = argmax(probs)
    return F.when(empty, F.transform(preds, lambda x, j: F.when(j == top1, 1).otherwise(x))) \
        .otherwise(preds)


def apply_thresholds_ensure1(probs, thresholds) -> Column:
    """Thresholds, and the arg-max class when a row would be empty."""
    return _ensure_one(apply_thresholds(probs, thresholds), probs)


def apply_global_threshold(probs, thr: float) -> Column:
    """One threshold for all classes."""
    return F.transform(_c(probs), lambda p: (p >= F.lit(float(thr))).cast("int"))


def topk_indices(probs, k: int) -> Column:
    """Indices of the ``k`` largest probabilities, best first (k above the
    class count means all)."""
    ranked = F.array_sort(F.transform(_c(probs), lambda p, i: F.struct((-p).alias("n"),
                                                                       i.alias("i"))))
    return F.transform(F.slice(ranked, 1, max(int(k), 0)), lambda s: s["i"])


def apply_topk(probs, k: int) -> Column:
    """The ``k`` best classes set to 1."""
    top = topk_indices(probs, k)
    return F.transform(_c(probs), lambda p, j: F.array_contains(top, j).cast("int"))


def apply_topk_with_minp(probs, k: int, p_min: float) -> Column:
    """C11: the ``k`` best classes with ``p >= p_min``; the arg-max when none passes."""
    top = topk_indices(probs, k)
    picked = F.transform(_c(probs), lambda p, j: (F.array_contains(top, j)
                                                  & (p >= F.lit(float(p_min)))).cast("int"))
    return _ensure_one(picked, probs)


def union_multi_hot(a, b) -> Column:
    """Element-wise OR of two multi-hot arrays."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y))


def apply_thresholds_or_topk(probs, thresholds, k: int) -> Column:
    """Thresholds united with the top-k classes; ``k = 0`` turns top-k off."""
    thr = apply_thresholds(probs, thresholds)
    return union_multi_hot(thr, apply_topk(probs, k)) if k and k > 0 else thr


def decode(probs, mode: str, thresholds: Sequence[float] | DataFrame | Column | None = None,
           k: int = 3, thr: float = 0.7, p_min: float = 0.40) -> Column:
    """Decode-mode dispatch; unknown modes are an error."""
    if mode == "threshold":
        return apply_thresholds(probs, thresholds)
    if mode == "threshold_ensure1":
        return apply_thresholds_ensure1(probs, thresholds)
    if mode == "global":
        return apply_global_threshold(probs, thr)
    if mode == "topk":
        return apply_topk(probs, k)
    if mode == "topk_minp":
        return apply_topk_with_minp(probs, k, p_min)
    raise ValueError("mode must be one of: " + " | ".join(MODES))


def mode_suffix(mode: str, k: int = 3, thr: float = 0.7, p_min: float = 0.40) -> str:
    """The metrics file-name suffix of a decode mode."""
    if mode == "threshold":
        return ""
    if mode == "threshold_ensure1":
        return "_thrEnsure1"
    if mode == "global":
        return f"_global{thr:.2f}"
    if mode == "topk":
        return f"_top{k}"
    if mode == "topk_minp":
        return f"_top{k}_p{p_min:.2f}"
    raise ValueError("mode must be one of: " + " | ".join(MODES))


def long_form(df: DataFrame, key: str, arr: str, value: str = "y") -> DataFrame:
    """``(key, class_idx, value)`` rows of an array column."""
    return df.select(key, F.posexplode(arr).alias("class_idx", value)) \
        .select(key, F.col("class_idx").cast("int"), value)
