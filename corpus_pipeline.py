"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.llm import secrets
from subjex.llm.common import fresh, nested, read, unnested
from subjex.llm.decontaminate import find_leaks
from subjex.llm.near_dup import near_duplicates
from subjex.llm.ordinal import judge
from subjex.llm.packing import pack
from subjex.session import ship_package, written

#: Share of common five-word shingles from which documents count as copies in the pipeline.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably sound and clean; the classifier trains on the labels of
    documents that are still there.  Null texts are judged like empty ones."""
    return unnested(judge(docs, read(spark, sf_dir, "labels")).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.  Of rows with equal
    ids all stay or go together; rows without an id stay."""
    groups = near_duplicates(docs.select("doc_id", "text"), NEAR_PERCENT)
    gone = groups.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    leaks = fresh("leaks", docs.columns)
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"), out=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows where the text changed."""
    found = secrets.scan(nested(docs, text=F.col("text")), out="found")
    spans = F.col("found.spans")
    changed = found.select("row", F.size(spans).alias("n"), secrets.redact(F.col("text"), spans).alias("clean"))
    length = F.when(F.col("n") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("clean"), "n_chars": length}
    return unnested(changed, docs.columns, **new).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("secret scans", redact_secrets),
          ("best-fit packing", packing)]

#: A learned classifier and a tokenizer are no SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
