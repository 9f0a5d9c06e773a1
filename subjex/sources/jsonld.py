"""JSON-LD document trees -> corpus records.

The scan is one row per file (``wholetext``), so each document is parsed by the
task that reads it; the whole conversion is one stage without a shuffle (the
exclusion list is joined by broadcast when it is measured small, else shuffled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions import records as R
from subjex.session import spread


def scan_documents(spark: SparkSession, raw_dir: str, pattern: str = "*.jsonld") -> DataFrame:
    """``(file_name, doc)`` for every file matching ``pattern`` below ``raw_dir``."""
    docs = (spark.read.text(raw_dir, wholetext=True, recursiveFileLookup=True,
                            pathGlobFilter=pattern)
                 .select(F.col("_metadata.file_name").alias("file_name"),
                         F.col("value").alias("doc")))
    return spread(docs)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """S3: base names listed under ``Records`` of a JSON exclusion file."""
    raw = spark.read.option("multiLine", True).schema("Records ARRAY<STRING>").json(path)
    return exclusion_names(raw)


def exclusion_names(raw: DataFrame, col: str = "Records") -> DataFrame:
    """S3 + U2: ``(file_name)`` - distinct base names of the listed paths."""
    return (raw.select(F.explode(col).alias("p"))
               .select(F.element_at(F.filter(F.split("p", "/"), lambda s: s != F.lit("")), -1)
                       .alias("file_name"))
               .where(F.col("file_name").isNotNull())
               .distinct())


def drop_excluded(docs: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Left-anti join on the base name."""
    if excluded is None:
        return docs
    return docs.join(excluded.select("file_name"), "file_name", "left_anti")


def parse_documents(docs: DataFrame) -> DataFrame:
    """``(file_name, v)`` with ``v`` NULL for a document that does not parse."""
    return docs.select("file_name", F.try_parse_json("doc").alias("v"))


def rejects(parsed: DataFrame) -> DataFrame:
    """File names of documents that did not parse."""
    return parsed.where(F.col("v").isNull()).select("file_name")


def extract_records(parsed: DataFrame) -> DataFrame:
    """P1-P7 + F2: one corpus record per document that has a main node."""
    main = parsed.select("file_name", R.main_node("v").alias("m")).where(F.col("m").isNotNull())
    m = F.col("m")
    return main.select(
        R.record_id("file_name").alias("id"),
        R.record_type(R.as_string(R.field(m, "@type"))).alias("type"),
        R.language_code(R.as_string(R.field(m, "language"))).alias("language"),
        R.as_text(R.field(m, "title")).alias("title"),
        F.coalesce(R.as_text(R.field(m, "abstract")), F.lit("")).alias("abstract"),
        R.subject_ids(R.field(m, "dcterms:subject")).alias("gnd_subject_ids"),
        R.domain_codes(R.field(m, "subject")).alias("linsearch_codes"))


def corpus_counts(parsed: DataFrame) -> DataFrame:
    """A1: one row - files read, files that did not parse, files without a main
    node, records kept (what was written and what was removed)."""
    main = R.main_node("v")
    return parsed.select(F.col("v").isNull().alias("bad"), main.isNotNull().alias("ok")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("bad").cast("long")).alias("rejected"),
        F.sum((~F.col("bad") & ~F.col("ok")).cast("long")).alias("no_main_node"),
        F.sum(F.col("ok").cast("long")).alias("records"))


def build_corpus(spark: SparkSession, raw_dir: str, exclude: str | None = None) -> DataFrame:
    """Corpus conversion: scan, exclude, guard, parse, extract.

    F6: an empty scan is an error, as in the reference.
    """
    docs = scan_documents(spark, raw_dir)
    if exclude:
        docs = drop_excluded(docs, read_exclusions(spark, exclude))
    if docs.isEmpty():
        raise ValueError(f"no .jsonld files under {raw_dir}")
    return extract_records(parse_documents(docs))
