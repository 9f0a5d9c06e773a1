"""Sinks and JSON-lines sources.

Writers produce partitioned Parquet (default) or JSON lines; nothing is written
through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import assemble_text
from subjex.operators.decode import mode_suffix
from subjex.session import spread

CORPUS_SCHEMA = ("id STRING, type STRING, language STRING, title STRING, abstract STRING, "
                 "gnd_subject_ids ARRAY<STRING>, linsearch_codes ARRAY<STRING>")


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA,
               partitions: int | None = None) -> DataFrame:
    """JSON lines (plain or ``.zst`` / ``.gz``), blank lines skipped.

    A compressed file is read by one task (not splittable): the rows are spread
    right after the read (to ``partitions``, or to the cluster's parallelism when
    the read has fewer splits than that).
    """
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else spread(df)


def load_split(df: DataFrame, text_fields: Sequence[str], label_key: str) -> DataFrame:
    """``(id, text, labels)`` - fields assembled with [SEP] (P10), labels as strings."""
    return df.select("id", assemble_text(*text_fields).alias("text"),
                     F.transform(F.coalesce(F.col(label_key), F.array().cast("array<string>")),
                                 lambda x: x.cast("string")).alias("labels"))


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The corpus table; Parquet by default, gzip JSON lines on request."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        df.write.mode("overwrite").option("compression", "gzip").json(path)
    else:
        raise ValueError("fmt must be parquet or json")


def write_corpus_bucketed(df: DataFrame, table_name: str, key: str = "id",
                          buckets: int = 1024) -> None:
    """S10, co-located form: the corpus as a table bucketed (and sorted) by record
    id.  A scan of it reports ``hashpartitioning(key)``, which satisfies every
    per-record aggregate and window downstream (term counts, per-label sums,
    top-k), so those run without exchanges."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
       .saveAsTable(table_name))


def write_embeddings(df: DataFrame, path: str, split_col: str = "split") -> None:
    """``(id, embedding, split)`` partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_embeddings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S11 + F7: one split (partition pruning) or all."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_subject_predictions(best: DataFrame, key: str, path: str, n_out: int | None = None) -> None:
    """``{"id", "gnd_pred"}`` JSON lines from ranked candidates."""
    from subjex.operators.suggest import prediction_lists
    prediction_lists(best, key, n_out).select(F.col(key).cast("string").alias("id"), "gnd_pred") \
        .write.mode("overwrite").json(path)


def write_domain_predictions(pred: DataFrame, path: str) -> None:
    """``{"id", "labels", "probs"}`` JSON lines, probabilities rounded to 6 digits."""
    pred.select("id", "labels", F.transform("probs", lambda p: F.round(p, 6)).alias("probs")) \
        .write.mode("overwrite").json(path)


def metrics_path(base: str, mode: str, **params) -> str:
    """The metrics file name with the decode-mode suffix before the extension."""
    root, dot, ext = base.rpartition(".")
    if not dot:
        return base + mode_suffix(mode, **params)
    return f"{root}{mode_suffix(mode, **params)}.{ext}"


def write_metrics(metrics: DataFrame, per_class: DataFrame, path: str) -> None:
    """The metric bundle and the per-class report, two small tables."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    per_class.coalesce(1).write.mode("overwrite").json(f"{path}/per_class")


def write_thresholds(thresholds: DataFrame, path: str, dev_metrics: DataFrame | None = None) -> None:
    """``(class_idx, threshold)``, and the scores they reach on the dev split."""
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")
    if dev_metrics is not None:
        dev_metrics.write.mode("overwrite").parquet(f"{path}/dev_metrics")


def read_thresholds(spark: SparkSession, path: str, metrics: bool = False):
    """S16 (read): the thresholds, with ``metrics`` also the dev scores stored with them."""
    thresholds = spark.read.parquet(f"{path}/thresholds")
    return (thresholds, spark.read.parquet(f"{path}/dev_metrics")) if metrics else thresholds
