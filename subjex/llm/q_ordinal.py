"""Query of the quality classifier."""

from subjex.llm.common import read
from subjex.llm.ordinal import classify


def op7_ordinal_quality(spark, sf_dir):
    """Expected grade and tail probability of every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])


QUERIES = {"op7_ordinal_quality": (op7_ordinal_quality, None)}
