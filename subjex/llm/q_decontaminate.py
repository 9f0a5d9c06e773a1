"""Query of the benchmark decontamination."""

from pyspark.sql import functions as F

from subjex.llm.common import read
from subjex.llm.decontaminate import find_leaks


def op9_bm25_decontamination(spark, sf_dir):
    """Benchmark items found in documents, with scores and overlaps."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


QUERIES = {"op9_bm25_decontamination": (op9_bm25_decontamination, None)}
