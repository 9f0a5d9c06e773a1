"""Registered lexical queries: BM25 statistics, scores, top-k and min-max scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.operators.lexical import bm25_top_k, build_bm25
from subjex.plans import fixtures as fx
from subjex.plans.catalog import register
from subjex.plans.sqlparts import bm25_ctes, minmax_ctes
from subjex.sources.tables import table

TOPK = 5

_BM25_DOCS = bm25_ctes("vocab", "gnd_id", "label_text", "documents", "doc_id", "text")


def _best(spark, sf_dir):
    return bm25_top_k(table(spark, sf_dir, "documents"), build_bm25(fx.vocab(spark, sf_dir)), "doc_id", "text", TOPK)


@register("l2_bm25_topk", f"""
with {fx.VOCAB_SQL}, {_BM25_DOCS},
rk as (select qkey, lid, score,
         row_number() over (partition by qkey order by round(score, 9) desc, lid) as rnk
       from bm25)
select qkey as doc_id, lid as gnd_id, cast(rnk as integer) as rank, round(score, 6) as score
from rk where rnk <= {TOPK}""")
def l2_bm25_topk(spark, sf_dir):
    """L2 + W1: the five best vocabulary entries per document by BM25."""
    return _best(spark, sf_dir).select("doc_id", "gnd_id", "rank", F.round("score", 6).alias("score"))


@register("l1_bm25_postings", f"""
with {fx.VOCAB_SQL}, {_BM25_DOCS}
select post.term, post.lid as gnd_id, round(post.w, 6) as w, round(idf.idf, 6) as idf
from post join idf on post.term = idf.term""")
def l1_bm25_postings(spark, sf_dir):
    """L1: postings with the folded BM25 weight and the term idf."""
    index = build_bm25(fx.vocab(spark, sf_dir))
    return (index.postings.join(index.idf, "term")
            .select("term", "gnd_id", F.round("w", 6).alias("w"), F.round("idf", 6).alias("idf")))


@register("l3_bm25_minmax", f"""
with {fx.VOCAB_SQL}, {_BM25_DOCS}, {minmax_ctes()},
rk as (select qkey, lid, score,
         row_number() over (partition by qkey order by round(score, 9) desc, lid) as rnk from bm25)
select rk.qkey as doc_id, rk.lid as gnd_id, round((score - mn) / den, 6) as bm25_scaled,
       round(mn, 6) as score_min, round(mn + den, 6) as score_max
from rk join mm on rk.qkey = mm.qkey where rnk <= {TOPK}""")
def l3_bm25_minmax(spark, sf_dir):
    """The best scores scaled to [0, 1] per document over all labels, with the bounds."""
    return _best(spark, sf_dir).select(
        "doc_id", "gnd_id", F.round("bm25_scaled", 6).alias("bm25_scaled"), F.round("_mn", 6).alias("score_min"),
        F.round(F.col("_mn") + F.col("_den"), 6).alias("score_max"))
