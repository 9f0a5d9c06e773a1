"""Structured Streaming form of record-by-record inference.

The reference reads its input lazily and processes fixed-size batches.  Here the
input is a file stream (JSON lines, Parquet, ...) with ``trigger(availableNow)``:
row-local operators (text assembly, prompts, decoding) run on the stream as
they are; retrieval needs per-record windows, which streams do not allow, so it
runs inside ``foreachBatch`` on each micro-batch, appending to a table.  Every
micro-batch is committed with its offsets in the checkpoint folder, so a lost
executor or driver restart resumes without duplicates in the file sink.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.session import scratch_path
from subjex.sources import jsonld


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json",
                pattern: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the folder ``path`` with an explicit schema (no inference
    on streams); ``pattern`` selects files by name."""
    r = spark.readStream.schema(schema).format(fmt)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def convert_tree(spark: SparkSession, raw_dir: str, out_path: str, checkpoint: str, exclude: str | None = None,
                 pattern: str = "*.jsonld", max_files_per_trigger: int = 100_000) -> DataFrame:
    """S1, F1, F6, incremental: the corpus of a tree of documents, converted so far.

    Each run converts the files that no earlier run has: the checkpoint lists the files taken,
    and the file sink's log under ``out_path`` the parts committed, so a run that was killed is
    finished by the next one and adds nothing twice (read the result through this function or
    ``spark.read.parquet``, which follow that log).  A file that changes after it was converted
    is not taken again.  ``exclude`` is read at each run.  No file at all is an error, also when
    everything is excluded.
    """
    files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files_per_trigger).text(raw_dir)
    docs = files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("doc"))
    here = jsonld.scan_documents(spark, raw_dir, pattern)
    if exclude:
        excluded = jsonld.read_exclusions(spark, exclude)
        docs, here = jsonld.drop_excluded(docs, excluded), jsonld.drop_excluded(here, excluded)
    if here.select("file_name").isEmpty():
        raise ValueError(f"no {pattern} files under {raw_dir}")
    write_available_now(jsonld.extract_records(jsonld.parse_documents(docs)), out_path, checkpoint)
    return spark.read.parquet(out_path)


def table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A stream over the Parquet table ``name`` of a data folder: all files of a table
    folder, or the one file when the table is a single file (a stream needs a folder)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getFileStatus(path).isDirectory():
        return read_stream(spark, path.toString(), schema, "parquet")
    return read_stream(spark, folder, schema, "parquet", f"{name}.parquet")


def write_available_now(sdf: DataFrame, out_path: str, checkpoint: str,
                        fmt: str = "parquet") -> None:
    """Run a row-local stream over everything available, append to ``out_path``."""
    q = (sdf.writeStream.format(fmt).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def foreach_batch_available_now(sdf: DataFrame, fn: Callable[[DataFrame], DataFrame],
                                out_path: str, checkpoint: str) -> None:
    """Run a batch operator (e.g. suggestion) on every micro-batch; each batch's
    result is written (overwrite) to its own ``epoch=<id>`` folder, so a batch
    that is run again after a failure replaces its output instead of adding to it."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    q = (sdf.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_to_table(spark: SparkSession, sdf: DataFrame, name: str,
                    fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream to completion into a fresh folder below the checkpoint folder
    and return the written table."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    if fn is None:
        write_available_now(sdf, out, ckpt)
        return spark.read.parquet(out)
    foreach_batch_available_now(sdf, fn, out, ckpt)
    return spark.read.parquet(out).drop("epoch")
