"""The registered queries of the training-data operators and the pipeline."""

import corpus_pipeline
from subjex.llm import (q_ball_search, q_centroids, q_decontaminate, q_jaccard_join, q_near_dup, q_ordinal,
                        q_packing, q_pii, q_rules, q_secrets, q_sharding, q_substrings, q_warc)

_MODULES = (q_warc, q_secrets, q_sharding, q_pii, q_rules, q_packing, q_ordinal, q_substrings, q_decontaminate,
            q_near_dup, q_jaccard_join, q_ball_search, q_centroids)
_ALL = {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}


def queries():
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
