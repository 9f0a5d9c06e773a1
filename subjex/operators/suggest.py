"""Subject suggestion end to end: dense, hybrid, rerank.

Inputs are keyed tables, never positional: ``docs(<key>, <text>, <vector>)`` and
``labels(gnd_id, label_text, <vector>)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.operators.lexical import Bm25Index, bm25_summary, build_bm25, minmax_columns
from subjex.functions.text import pair_text, retrieval_query_text
from subjex.operators.label_index import DEFAULT_NPROBE, LabelIndex
from subjex.operators.neighbors import exact_top_k
from subjex.operators.ranking import ranked_list, top_k
from subjex.operators.skew import hot_keys, salted_join

# The reference's search defaults.
DEFAULT_TOPK = 50
DEFAULT_BM25_WEIGHT = 0.3
DEFAULT_RERANK_HYBRID = 30
HYBRID_N_OUT = 20

# Records of a partition that goes to the lexical workers, so many partitions at most.
BATCH_ROWS = 4096
MAX_PARTITIONS = 8192

PairScorer = Callable[[Column, Column], Column]


def dense_candidates(docs: DataFrame, key: str, vec: str, labels: DataFrame,
                     k: int, label_vec: str = "embedding", label_index: LabelIndex | None = None,
                     nprobe: int = DEFAULT_NPROBE) -> DataFrame:
    """V1 / V5: ``(key, gnd_id, cosine, rank)`` - the k nearest labels by cosine, exact, or
    from the ``nprobe`` nearest cells of a stored index."""
    if label_index is not None:
        return label_index.search(docs, key, vec, k, nprobe).withColumnRenamed("score", "cosine")
    return (exact_top_k(docs, key, vec, labels, "gnd_id", label_vec, k)
            .withColumnRenamed("score", "cosine"))


def _records(docs: DataFrame, key: str, text: str, cands: DataFrame) -> DataFrame:
    """Records with their candidates, in partitions of about ``BATCH_ROWS``: a worker holds two Arrow
    batches with the tokens of whole texts, and a batch ends with its partition."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(MAX_PARTITIONS, -(-docs.count() // BATCH_ROWS)))
    return docs.select(key, text).repartition(parts, key).join(cands, key)


def hybrid_scores(docs: DataFrame, key: str, text: str, vec: str, labels: DataFrame,
                  topk: int, weight: float = DEFAULT_BM25_WEIGHT,
                  index: Bm25Index | None = None, label_vec: str = "embedding",
                  with_shared: bool = False, label_index: LabelIndex | None = None,
                  nprobe: int = DEFAULT_NPROBE) -> DataFrame:
    """H1: dense candidates (2 x topk, V5) with ``(1-w) * cosine + w * bm25_scaled``.

    J7 + L3 without (record, label) pairs: each record's candidates travel with it as
    one array (at most 2 x topk), and the blocked lexical scoring returns their scores
    and the min-max statistics over all matching labels (implicit zeros included).  A
    candidate without a shared term gets the scaled value of zero.
    ``with_shared`` also returns ``shared`` (distinct shared terms).
    """
    index = index or build_bm25(labels.select("gnd_id", "label_text"))
    cands = dense_candidates(docs, key, vec, labels, 2 * topk, label_vec, label_index, nprobe) \
        .groupBy(key).agg(F.collect_list(F.struct("gnd_id", "cosine")).alias("_c"))
    lex = bm25_summary(_records(docs, key, text, cands), index, text, candidates=F.col("_c.gnd_id"), keep_text=False)
    mn, den = minmax_columns(index.n_labels)
    ex = lex.select(key, mn.alias("_mn"), den.alias("_den"), F.explode(F.arrays_zip("_c", "_cand")).alias("x"))
    extra = [F.col("x._cand.shared").alias("shared")] if with_shared else []
    out = ex.select(key, F.col("x._c.gnd_id").alias("gnd_id"), F.col("x._c.cosine").alias("cosine"),
                    ((F.col("x._cand.score") - F.col("_mn")) / F.col("_den")).alias("bm25_scaled"), *extra)
    return out.withColumn(
        "hybrid", F.lit(1.0 - weight) * F.col("cosine") + F.lit(weight) * F.col("bm25_scaled"))


def overlap_scorer(index: Bm25Index) -> DataFrame:
    """Distinct term count per label, for the default pair score ``shared / terms``."""
    return index.postings.groupBy(index.id_col).agg(F.count(F.lit(1)).alias("label_terms"))


def rerank(cands: DataFrame, key: str, r: int, pair_score: Column, k: int,
           keep_unranked_below: bool = False) -> DataFrame:
    """The first ``r`` candidates (by ``rank``) take the pair score, the rest
    keep ``score``; then re-sort and cut to ``k`` (W2).  By default scores of both
    kinds are mixed, as in the reference's dense rerank; ``keep_unranked_below``
    keeps every rescored candidate above every other one."""
    rescored = F.col("rank") <= r
    out = cands.withColumn("_tier", rescored.cast("int")) \
        .withColumn("score", F.when(rescored, pair_score).otherwise(F.col("score"))).drop("rank")
    if keep_unranked_below:
        return top_k(out, key, "gnd_id", "score", k, tier="_tier").drop("_tier")
    return top_k(out.drop("_tier"), key, "gnd_id", "score", k)


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs with ``label_text``."""
    hot = hot_keys(pairs.groupBy("gnd_id").agg(F.count(F.lit(1)).alias("n")), ["gnd_id"])
    return salted_join(pairs, labels.select("gnd_id", "label_text"), ["gnd_id"], hot)


def rerank_pairs(cands: DataFrame, key: str, rank_col: str, r: int, docs: DataFrame,
                 pair_text: Column, labels: DataFrame) -> DataFrame:
    """The first ``r`` candidates with their texts, for a custom pair scorer."""
    pairs = cands.filter(F.col(rank_col) <= r)
    return _named(pairs, labels).join(docs.select(key, pair_text.alias("query_text")), key)


def suggest_hybrid(docs: DataFrame, key: str, text: str, vec: str, labels: DataFrame,
                   topk: int = DEFAULT_TOPK, weight: float = DEFAULT_BM25_WEIGHT,
                   rerank_n: int = 0, n_out: int = HYBRID_N_OUT,
                   scorer: PairScorer | None = None, label_vec: str = "embedding",
                   label_index: LabelIndex | None = None, nprobe: int = DEFAULT_NPROBE) -> DataFrame:
    """H2: ``(key, rank, gnd_id, score)`` - hybrid top-k, optional rerank, first ``n_out``."""
    index = build_bm25(labels.select("gnd_id", "label_text"))
    need_shared = rerank_n > 0 and scorer is None
    hy = hybrid_scores(docs, key, text, vec, labels, topk, weight, index, label_vec,
                       with_shared=need_shared, label_index=label_index, nprobe=nprobe)
    cols = [key, "gnd_id", F.col("hybrid").alias("score")] + (["shared"] if need_shared else [])
    best = top_k(hy.select(*cols), key, "gnd_id", "score", topk)
    if rerank_n > 0:
        best = _apply_rerank(best, key, rerank_n, topk, index, docs, text, labels, scorer)
    return best.filter(F.col("rank") <= n_out).select(key, "rank", "gnd_id", "score")


def suggest_dense(docs: DataFrame, key: str, text: str, vec: str, labels: DataFrame,
                  topk: int = DEFAULT_TOPK, rerank_n: int = 0,
                  scorer: PairScorer | None = None, label_vec: str = "embedding",
                  label_index: LabelIndex | None = None, nprobe: int = DEFAULT_NPROBE) -> DataFrame:
    """H3: ``(key, rank, gnd_id, score)`` - dense top-k, optional rerank."""
    best = dense_candidates(docs, key, vec, labels, topk, label_vec, label_index, nprobe) \
        .withColumnRenamed("cosine", "score")
    if rerank_n > 0:
        index = build_bm25(labels.select("gnd_id", "label_text"))
        if scorer is None:
            mine = best.groupBy(key).agg(F.collect_list(F.struct("gnd_id", "score", "rank")).alias("_c"))
            lex = bm25_summary(_records(docs, key, text, mine), index, text, candidates=F.col("_c.gnd_id"), keep_text=False)
            best = lex.select(key, F.explode(F.arrays_zip("_c", "_cand")).alias("x")) \
                .select(key, "x._c.*", F.col("x._cand.shared").alias("shared"))
        best = _apply_rerank(best, key, rerank_n, topk, index, docs, text, labels, scorer)
    return best.select(key, "rank", "gnd_id", "score")


def _apply_rerank(best, key, r, k, index, docs, text, labels, scorer):
    if scorer is None:
        # Default pair score: share of the label's distinct terms found in the
        # record, from the BM25 join (no per-pair text is moved).
        best = best.join(overlap_scorer(index), "gnd_id", "left")
        pair = F.coalesce(F.col("shared") / F.col("label_terms"), F.lit(0.0))
        return rerank(best, key, r, pair, k)
    if hasattr(scorer, "many"):
        # a record meets all its first candidates at once: its text moves once
        lists = _named(best.filter(F.col("rank") <= r), labels).groupBy(key) \
            .agg(F.collect_list(F.struct("gnd_id", "label_text")).alias("_l"))
        scored = docs.select(key, F.col(text).alias("_text")).join(lists, key) \
            .select(key, "_l", scorer.many(F.col("_text"), F.col("_l.label_text")).alias("_p")) \
            .select(key, F.explode(F.arrays_zip("_l", "_p")).alias("x")) \
            .select(key, F.col("x._l.gnd_id").alias("gnd_id"), F.col("x._p").alias("_pair"))
    else:
        pairs = rerank_pairs(best, key, "rank", r, docs, F.col(text), labels)
        scored = pairs.select(key, "gnd_id", scorer(F.col("query_text"), F.col("label_text"))
                              .alias("_pair"))
    best = best.join(scored, [key, "gnd_id"], "left")
    return rerank(best, key, r, F.col("_pair"), k)


def prediction_lists(best: DataFrame, key: str, n_out: int | None = None) -> DataFrame:
    """S13 shape: ``(key, gnd_pred ARRAY<STRING>)`` in rank order."""
    return ranked_list(best, key, "gnd_id", "rank", n_out, "gnd_pred")


def suggest_subjects(records: DataFrame, key: str, title: str, abstract: str, label_index: LabelIndex, encoder,
                     topk: int = DEFAULT_TOPK, weight: float = DEFAULT_BM25_WEIGHT, rerank_n: int = 0,
                     n_out: int = HYBRID_N_OUT, nprobe: int = DEFAULT_NPROBE) -> DataFrame:
    """Text in, subjects out: ``(key, gnd_pred)`` from title and abstract.

    ``encoder`` has ``transform(df, text_col, out)`` and is the one that encoded the labels
    of ``label_index``, so record and label vectors are comparable.
    """
    docs = records.select(key, pair_text(title, abstract).alias("_pair"), retrieval_query_text(title, abstract).alias("_query"))
    docs = encoder.transform(docs, "_query", "_vector")
    best = suggest_hybrid(docs, key, "_pair", "_vector", label_index.labels, topk, weight, rerank_n, n_out,
                          label_index=label_index, nprobe=nprobe)
    return prediction_lists(best, key, n_out)
