"""Query of the sharding operator."""

from pyspark.sql import functions as F

from subjex.llm.common import read
from subjex.llm.sharding import place


def op3_hilbert_shards(spark, sf_dir):
    """Documents along a Hilbert curve over language, source and size, in 40 shards of equal rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    placed = place(docs, ["lang", "source", "n_chars"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "cell")


QUERIES = {"op3_hilbert_shards": (op3_hilbert_shards, None)}
