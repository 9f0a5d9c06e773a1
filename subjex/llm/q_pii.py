"""Query of the surrogate generation."""

from pyspark.sql import functions as F

from subjex.llm import pii
from subjex.llm.common import read


def op4_pii_surrogates(spark, sf_dir):
    """Every document with surrogates for its personal data, and their numbers by kind."""
    docs = pii.anonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("replaced", lambda k: k == kind)).cast("long")
    return docs.select("doc_id", "text", *[number(k).alias(f"n_{k}") for k in pii.KINDS])


QUERIES = {"op4_pii_surrogates": (op4_pii_surrogates, None)}
