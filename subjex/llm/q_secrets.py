"""Query of the secret scan."""

from pyspark.sql import functions as F

from subjex.llm import secrets
from subjex.llm.common import read


def op2_secret_scan(spark, sf_dir):
    """Secrets in every whole text; the base part as the contract digests it."""
    docs = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    number = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return docs.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(secrets.joined(F.col("found.base")), 256).alias("base_sha256"),
        secrets.joined(F.col("found.spans")).alias("spans"))


QUERIES = {"op2_secret_scan": (op2_secret_scan, None)}
