"""Query of the packing operator."""

from subjex.llm.common import read
from subjex.llm.packing import pack


def op6_dominance_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op6_dominance_packing": (op6_dominance_packing, None)}
