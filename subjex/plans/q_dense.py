"""Registered dense, hybrid, rerank and zero-shot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjex.operators.cells import build_cells, search
from subjex.operators.neighbors import exact_top_k
from subjex.operators.suggest import (hybrid_scores, prediction_lists, suggest_dense,
                                      suggest_hybrid)
from subjex.operators.zeroshot import class_centroids, zero_shot
from subjex.plans import fixtures as fx
from subjex.plans.catalog import register
from subjex.plans.sqlparts import bm25_ctes, cosine_sql, minmax_ctes
from subjex.sources.tables import table

TOPK = 10
RERANK = 5
WEIGHT = 0.3
N_OUT = 20

_VEC = fx.TEXT_VEC_SQL
_PAIRS = f"""pairs as (select r.doc_id, l.gnd_id, {cosine_sql('r.embedding', 'l.embedding')} as cosine
          from rvec r, lvec l),
dense as (select doc_id, gnd_id, cosine,
            row_number() over (partition by doc_id order by round(cosine, 9) desc, gnd_id) as rnk
          from pairs)"""
_LEX = bm25_ctes("lvec", "gnd_id", "label_text", "rvec", "doc_id", "text") + "," + minmax_ctes()
_HYB = f"""hy as (select d.doc_id, d.gnd_id, d.cosine,
         coalesce((coalesce(b.score, 0.0) - m.mn) / m.den, 0.0) as bm25_scaled,
         coalesce(b.shared, 0) as shared
       from dense d left join bm25 b on d.doc_id = b.qkey and d.gnd_id = b.lid
       left join mm m on d.doc_id = m.qkey
       where d.rnk <= {2 * TOPK}),
hy2 as (select *, {1.0 - WEIGHT!r} * cosine + {WEIGHT!r} * bm25_scaled as hybrid from hy),
best as (select doc_id, gnd_id, hybrid as score, shared,
           row_number() over (partition by doc_id order by round(hybrid, 9) desc, gnd_id) as rnk
         from hy2)"""


def _inputs(spark, sf_dir):
    buckets = fx.record_buckets(spark, sf_dir)
    encoder = fx.text_encoder(spark, sf_dir, buckets)
    return fx.record_vectors(spark, sf_dir, encoder, buckets), fx.label_vectors(spark, sf_dir, encoder)


#: Exact neighbours over all pairs of rows of ``embeddings``.
_STORED = f"""near as (select a.vec_id, cast(b.vec_id as varchar) as gnd_id, {cosine_sql('a.embedding', 'b.embedding')} as cosine
  from embeddings a, embeddings b),
dense as (select *, row_number() over (partition by vec_id order by round(cosine, 9) desc, gnd_id) as rnk from near)"""


@register("v1_dense_topk", f"""
with {_STORED}
select vec_id, gnd_id, cast(rnk as integer) as rank, round(cosine, 6) as score
from dense where rnk <= {TOPK}""")
def v1_dense_topk(spark, sf_dir):
    """V1 + W1: the exact nearest stored vectors of every stored vector (blocked similarity join)."""
    queries, _ = fx.stored_vectors(spark, sf_dir)
    return (exact_top_k(queries, "vec_id", "embedding", fx.stored_labels(spark, sf_dir), "gnd_id", "embedding", TOPK)
            .select("vec_id", "gnd_id", "rank", F.round("score", 6).alias("score")))


@register("h1_hybrid_scores", f"""
with {_VEC}, {_PAIRS}, {_LEX}, {_HYB}
select doc_id, gnd_id, round(cosine, 6) as cosine, round(bm25_scaled, 6) as bm25_scaled,
       round(hybrid, 6) as hybrid
from hy2""")
def h1_hybrid_scores(spark, sf_dir):
    """H1 + J7 + V5: hybrid score of the 2 x topk dense candidates."""
    docs, labels = _inputs(spark, sf_dir)
    hy = hybrid_scores(docs, "doc_id", "text", "embedding", labels, TOPK, WEIGHT)
    return hy.select("doc_id", "gnd_id", F.round("cosine", 6).alias("cosine"),
                     F.round("bm25_scaled", 6).alias("bm25_scaled"),
                     F.round("hybrid", 6).alias("hybrid"))


@register("h2_hybrid_suggest", f"""
with {_VEC}, {_PAIRS}, {_LEX}, {_HYB}
select doc_id, cast(rnk as integer) as rank, gnd_id, round(score, 6) as score
from best where rnk <= {min(TOPK, N_OUT)}""")
def h2_hybrid_suggest(spark, sf_dir):
    """H2: hybrid suggestion end to end, no rerank, first 20 of top-k."""
    docs, labels = _inputs(spark, sf_dir)
    out = suggest_hybrid(docs, "doc_id", "text", "embedding", labels, topk=TOPK,
                         weight=WEIGHT, rerank_n=0, n_out=N_OUT)
    return out.select("doc_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


@register("h3_dense_suggest", f"""
with {_STORED}
select vec_id, cast(rnk as integer) as rank, gnd_id, round(cosine, 6) as score
from dense where rnk <= {TOPK}""")
def h3_dense_suggest(spark, sf_dir):
    """H3: dense suggestion end to end over the stored vectors, no rerank (so no texts)."""
    queries, _ = fx.stored_vectors(spark, sf_dir)
    out = suggest_dense(queries, "vec_id", "", "embedding", fx.stored_labels(spark, sf_dir), topk=TOPK)
    return out.select("vec_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


@register("r1_dense_rerank", f"""
with {_VEC}, {_PAIRS}, {_LEX},
rr as (select d.doc_id, d.gnd_id,
         case when d.rnk <= {RERANK}
              then coalesce(coalesce(b.shared, 0) / lt.label_terms, 0.0) else d.cosine end as score
       from dense d left join bm25 b on d.doc_id = b.qkey and d.gnd_id = b.lid
       left join lterms lt on d.gnd_id = lt.lid
       where d.rnk <= {TOPK}),
rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, gnd_id) as rnk from rr)
select doc_id, cast(rnk as integer) as rank, gnd_id, round(score, 6) as score from rk""")
def r1_dense_rerank(spark, sf_dir):
    """R1 + W2: dense top-k, first R rescored by the pair scorer, re-sorted."""
    docs, labels = _inputs(spark, sf_dir)
    out = suggest_dense(docs, "doc_id", "text", "embedding", labels, topk=TOPK, rerank_n=RERANK)
    return out.select("doc_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


@register("r2_hybrid_rerank", f"""
with {_VEC}, {_PAIRS}, {_LEX}, {_HYB},
rr as (select b.doc_id, b.gnd_id,
         case when b.rnk <= {RERANK}
              then coalesce(b.shared / lt.label_terms, 0.0) else b.score end as score
       from best b left join lterms lt on b.gnd_id = lt.lid
       where b.rnk <= {TOPK}),
rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, gnd_id) as rnk from rr)
select doc_id, cast(rnk as integer) as rank, gnd_id, round(score, 6) as score
from rk where rnk <= {N_OUT}""")
def r2_hybrid_rerank(spark, sf_dir):
    """R2 + W2 + W3: hybrid top-k with the first R replaced by pair scores, first 20."""
    docs, labels = _inputs(spark, sf_dir)
    out = suggest_hybrid(docs, "doc_id", "text", "embedding", labels, topk=TOPK,
                         weight=WEIGHT, rerank_n=RERANK, n_out=N_OUT)
    return out.select("doc_id", "rank", "gnd_id", F.round("score", 6).alias("score"))


@register("s13_subject_predictions", f"""
with {_VEC}, {_PAIRS}, {_LEX}, {_HYB}
select cast(doc_id as varchar) as id, list(gnd_id order by rnk) as gnd_pred
from best where rnk <= {min(TOPK, N_OUT)} group by doc_id""")
def s13_subject_predictions(spark, sf_dir):
    """S13 + W3: ``{id, gnd_pred}`` records of the hybrid suggestion."""
    docs, labels = _inputs(spark, sf_dir)
    out = suggest_hybrid(docs, "doc_id", "text", "embedding", labels, topk=TOPK,
                         weight=WEIGHT, rerank_n=0, n_out=N_OUT)
    return prediction_lists(out, "doc_id").select(F.col("doc_id").cast("string").alias("id"),
                                                  "gnd_pred")


#: Cells of the registered approximate searches, 16 x 16, and how many a query probes.  The
#: stored vectors have no clusters (a vector's tenth neighbour has a cosine of 0.35), so a
#: recall of 0.9 needs half of all pairs; see tests/test_cells.py for vectors of texts.
BRANCHES, NPROBE, REFINE = (16, 16), 144, 4 * TOPK


@register("v3_ivf_topk")
def v3_ivf_topk(spark, sf_dir):
    """V2 + V3: a tree of 256 cells over all stored vectors, beam to 144 of them, exact inside."""
    queries, items = fx.stored_vectors(spark, sf_dir)
    index = build_cells(items, "neighbor_id", "embedding", BRANCHES)
    return search(queries, "vec_id", "embedding", index, TOPK, NPROBE) \
        .select("vec_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


_CENTROID_SQL = """cpos as (select label as class_idx, pos, avg(x::double) as x
         from (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as x
               from embeddings) group by label, pos),
cls as (select label, row_number() over (order by label) - 1 as class_idx from (select distinct label from embeddings)),
cvec as (select cls.class_idx, list(x order by pos) as embedding from cpos join cls on cpos.class_idx = cls.label group by 1),
zs as (select e.vec_id, c.class_idx,
         row_number() over (partition by e.vec_id
                            order by round(""" + cosine_sql("e.embedding", "c.embedding") + """, 9) desc,
                                     c.class_idx) as rnk
       from embeddings e, cvec c)"""


@register("z1_zero_shot", f"""
with {_CENTROID_SQL}
select vec_id, cast(class_idx as integer) as class_idx,
       cast(case when rnk <= 5 then 1 else 0 end as integer) as y
from zs""")
def z1_zero_shot(spark, sf_dir):
    """Cosine of each record to class vectors, the 5 best classes set to 1."""
    e = table(spark, sf_dir, "embeddings")
    classes = class_centroids(e, "label", "embedding")
    known = fx.class_table(spark, sf_dir)
    classes = classes.withColumnRenamed("class_idx", "label").join(F.broadcast(known), "label").select("class_idx", "embedding")
    tagged = zero_shot(e, "vec_id", "embedding", classes, len(fx.class_labels(spark, sf_dir)))
    return tagged.select("vec_id", F.posexplode("labels").alias("class_idx", "y")) \
        .select("vec_id", F.col("class_idx").cast("int"), F.col("y").cast("int"))


@register("m1_m3_vector_math", f"""
with cpos as (select label as class_idx, pos, avg(x::double) as x
         from (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as x
               from embeddings) group by label, pos),
cvec as (select class_idx, list(x order by pos) as embedding from cpos group by class_idx)
select e.vec_id,
       round(sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))), 6) as norm,
       round({cosine_sql('e.embedding', 'c.embedding')}, 6) as cos_class,
       round(1.0::double / (1.0::double + exp(-(8.0::double * {cosine_sql('e.embedding', 'c.embedding')}))), 6)
         as sig
from embeddings e join cvec c on e.label = c.class_idx""")
def m1_m3_vector_math(spark, sf_dir):
    """M1-M3: L2 norm, cosine to the record's class centroid (equi join on the
    class), and a sigmoid of the scaled cosine."""
    from subjex.functions.vectors import cosine, l2_normalize, sigmoid, sq_norm
    e = table(spark, sf_dir, "embeddings")
    c = class_centroids(e, "label", "embedding").withColumnRenamed("embedding", "centroid")
    j = e.join(c, e.label == c.class_idx)
    cos = cosine(l2_normalize("embedding"), "centroid")
    return j.select("vec_id", F.round(F.sqrt(sq_norm("embedding")), 6).alias("norm"),
                    F.round(cos, 6).alias("cos_class"),
                    F.round(sigmoid(F.lit(8.0) * cos), 6).alias("sig"))


@register("v4_pq_topk")
def v4_pq_topk(spark, sf_dir):
    """V4: residual codes (16 bytes a vector) of all stored vectors, scored by table sums; the
    best 40 of a block are scored again with their vectors."""
    queries, items = fx.stored_vectors(spark, sf_dir)
    index = build_cells(items, "neighbor_id", "embedding", BRANCHES, m=16)
    return search(queries, "vec_id", "embedding", index, TOPK, NPROBE, REFINE) \
        .select("vec_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


@register("j4_rerank_pairs", f"""
with {_VEC}, {_PAIRS}
select d.doc_id, d.gnd_id, cast(d.rnk as integer) as rank, r.text as query_text, l.label_text
from dense d join rvec r on d.doc_id = r.doc_id join lvec l on d.gnd_id = l.gnd_id
where d.rnk <= {RERANK}""")
def j4_rerank_pairs(spark, sf_dir):
    """The first R dense candidates with the record text and the label text."""
    from subjex.operators.suggest import dense_candidates, rerank_pairs
    docs, labels = _inputs(spark, sf_dir)
    cands = dense_candidates(docs, "doc_id", "embedding", labels, TOPK)
    pairs = rerank_pairs(cands, "doc_id", "rank", RERANK, docs, F.col("text"), labels)
    return pairs.select("doc_id", "gnd_id", "rank", "query_text", "label_text")
