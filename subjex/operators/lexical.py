"""Okapi BM25 over a label vocabulary as sparse DataFrame joins.

The reference scores every query against every label in memory.  Here the index
is three tables - postings, idf and two corpus scalars - and scoring is an equi
join of query terms with postings followed by an aggregate per (query, label).
A label that shares no term with a query has score 0 and produces no row; the
min-max scaling accounts for those implicit zeros, so results are exact.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.functions.text import whitespace_tokens
from subjex.operators.encoders import slices
from subjex.operators.ranking import RANK_DECIMALS
from subjex.operators.skew import hot_keys, salted_join
from subjex.session import ship_package, written

# The BM25 library defaults the reference relies on
# (it passes no parameters).
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# Fixed value: denominator guard of the per-record min-max scaling.
MINMAX_EPS = 1e-8


# Broadcast bounds: the term dictionary and the postings of a vocabulary are
# broadcast only when their measured row counts are below these.
MAX_BROADCAST_TERMS = 2_000_000
MAX_BROADCAST_POSTINGS = 5_000_000


@dataclass
class Bm25Index:
    """L1: ``postings(term, <id>, w)`` where ``w`` already folds idf, tf and length
    normalisation, so a query only multiplies by its term count."""

    postings: DataFrame
    idf: DataFrame
    n_labels: int
    avgdl: float
    id_col: str
    n_terms: int = 0
    n_postings: int = 0


def build_bm25(labels: DataFrame, id_col: str = "gnd_id", text_col: str = "label_text",
               k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON,
               tokens_col: str | None = None) -> Bm25Index:
    """L1: BM25 statistics of a label table (one row per label id, T9 tokens).

    Scalars reach the driver from two aggregates (label count, average length,
    posting count; term count, average idf); everything else stays distributed.
    """
    toks = labels.select(
        F.col(id_col),
        (F.col(tokens_col) if tokens_col else whitespace_tokens(text_col)).alias("_toks"))
    toks = toks.select(id_col, F.size("_toks").alias("dl"), "_toks")
    st = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"),
                  F.sum(F.size(F.array_distinct("_toks"))).alias("np")).first()
    n, avgdl, n_post = int(st["n"]), float(st["avgdl"] or 0.0), int(st["np"] or 0)

    tf = (toks.select(id_col, "dl", F.explode("_toks").alias("term"))
              .groupBy(id_col, "term", "dl").agg(F.count(F.lit(1)).alias("tf")))
    raw = (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
             .select("term", (F.log(F.lit(float(n)) - F.col("df") + F.lit(0.5))
                              - F.log(F.col("df") + F.lit(0.5))).alias("idf_raw")))
    it = raw.agg(F.avg("idf_raw").alias("a"), F.count(F.lit(1)).alias("nt")).first()
    avg_idf, n_terms = float(it["a"] or 0.0), int(it["nt"])
    idf = raw.select("term", F.when(F.col("idf_raw") < 0, F.lit(epsilon * avg_idf))
                     .otherwise(F.col("idf_raw")).alias("idf"))
    length_norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
    postings = (tf.join(idf, "term")
                  .select("term", id_col,
                          (F.col("idf") * F.col("tf") * F.lit(k1 + 1.0)
                           / (F.col("tf") + length_norm)).alias("w")))
    return Bm25Index(postings=postings, idf=idf, n_labels=n, avgdl=avgdl, id_col=id_col,
                     n_terms=n_terms, n_postings=n_post)


def _tokens(queries: DataFrame, key: str, text_col: str | None, tokens_col: str | None,
            index: Bm25Index | None) -> DataFrame:
    toks = F.col(tokens_col) if tokens_col else whitespace_tokens(text_col)
    ex = queries.select(key, F.explode(toks).alias("term"))
    if index is not None and index.n_terms <= MAX_BROADCAST_TERMS:
        # tokens that are no vocabulary term cannot score: drop them before any
        # shuffle (the term list is bounded by the measured count above)
        ex = ex.join(F.broadcast(index.idf.select("term")), "term", "left_semi")
    return ex


def query_terms(queries: DataFrame, key: str, text_col: str | None = None,
                tokens_col: str | None = None, index: Bm25Index | None = None) -> DataFrame:
    """Query side: ``(key, term, qf)``; repeated query terms count ``qf`` times.

    The aggregate is combined map-side (all tokens of one record sit in one task),
    so only distinct (record, term) rows cross the shuffle.
    """
    return (_tokens(queries, key, text_col, tokens_col, index)
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("qf")))


def bm25_scores(queries: DataFrame, index: Bm25Index, key: str,
                text_col: str | None = None, tokens_col: str | None = None,
                with_shared: bool = False) -> DataFrame:
    """L2: ``(key, <label id>, score)`` for every label sharing at least one term.

    Tokens that are no vocabulary term are dropped where they are read; the
    rest are counted per (record, term), combined map-side.  The counts join the
    postings - broadcast when the postings are measured small, else shuffled on
    the term (AQE splits skewed, frequent terms) - and are summed per (record,
    label), again combined map-side.  Counting first matters: a frequent term
    repeats within a record, and every repeat would otherwise meet every label
    holding the term.  ``with_shared`` adds the number of distinct shared terms.
    """
    q = query_terms(queries, key, text_col=text_col, tokens_col=tokens_col, index=index)
    if index.n_postings <= MAX_BROADCAST_POSTINGS:
        joined = q.join(F.broadcast(index.postings), "term")
    else:
        # shuffle join on the term: a term held by very many records is split
        # by salt, its postings repeated once per salt
        load = q.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        joined = salted_join(q, index.postings, ["term"], hot_keys(load, ["term"]))
    aggs = [F.sum(F.col("qf") * F.col("w")).alias("score")]
    if with_shared:
        aggs.append(F.count(F.lit(1)).alias("shared"))
    return joined.groupBy(key, index.id_col).agg(*aggs)


def minmax_scale(scores: DataFrame, key: str, n_labels: int, score: str = "score",
                 out: str = "bm25_scaled") -> DataFrame:
    """``(s - min) / (max - min + 1e-8)`` per record over *all* labels.

    ``scores`` holds only labels with a non-zero match; when a record matched fewer
    than ``n_labels`` labels, the implicit zeros take part in min and max.
    Adds ``_mn``/``_den`` so that the scaled value of an absent label is
    ``(0 - _mn) / _den`` (see ``scaled_zero``).
    """
    w = Window.partitionBy(key)
    cnt = F.count(F.lit(1)).over(w)
    mn = F.min(score).over(w)
    mx = F.max(score).over(w)
    has_zero = cnt < F.lit(n_labels)
    mn = F.when(has_zero, F.least(mn, F.lit(0.0))).otherwise(mn)
    mx = F.when(has_zero, F.greatest(mx, F.lit(0.0))).otherwise(mx)
    return (scores.withColumn("_mn", mn)
                  .withColumn("_den", mx - F.col("_mn") + F.lit(MINMAX_EPS))
                  .withColumn(out, (F.col(score) - F.col("_mn")) / F.col("_den")))


def record_minmax(scores: DataFrame, key: str, n_labels: int, score: str = "score") -> DataFrame:
    """Per-record ``(key, _mn, _den)`` of the min-max scaling, as an aggregate."""
    agg = scores.groupBy(key).agg(F.count(F.lit(1)).alias("_cnt"), F.min(score).alias("_mn0"),
                                  F.max(score).alias("_mx0"))
    has_zero = F.col("_cnt") < F.lit(n_labels)
    mn = F.when(has_zero, F.least("_mn0", F.lit(0.0))).otherwise(F.col("_mn0"))
    mx = F.when(has_zero, F.greatest("_mx0", F.lit(0.0))).otherwise(F.col("_mx0"))
    return agg.select(key, mn.alias("_mn"), (mx - mn + F.lit(MINMAX_EPS)).alias("_den"))


# ---------------------------------------------------------------------------
# Blocked scoring: records stay where they are, stored label blocks come to them

# Postings per label block: what a task holds of the index (about 40 bytes each).
BLOCK_POSTINGS = 1_000_000
# Labels that share one maximum per term.
SUB_LABELS = 64
# Sub-blocks scored before the others are held against the k-th score.
FIRST_SUBS = 4
# Labels that are asked for a common term before all are taken to match.
PROBES = 256
_TOP = pa.struct([("id", pa.string()), ("score", pa.float64()), ("shared", pa.int64())])
_CAND = pa.struct([("score", pa.float64()), ("shared", pa.int64())])
_STATE = ("_cnt bigint, _mn0 double, _mx0 double, _top array<struct<id:string,score:double,shared:bigint>>, "
          "_cand array<struct<score:double,shared:bigint>>")


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. end[i] - 1 of all i in turn."""
    n = end - start
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


class LabelBlock:
    """Postings of some labels, by term and by label, with a maximum per term and sub-block.

    Labels are numbered in the order of their ids, ``SUB_LABELS`` to a sub-block; terms are
    64-bit hashes.  Built in a task (``label_blocks``), stored as bytes.
    """

    def __init__(self, term: np.ndarray, ids: list[str], weight: np.ndarray):
        self.ids, label = np.unique(np.array(ids, object), return_inverse=True)
        self.terms, term = np.unique(term, return_inverse=True)
        order = np.lexsort((label, term))
        self.label, self.weight, term = label[order].astype(np.int32), weight[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        sub = self.label // SUB_LABELS
        self.first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (sub[1:] != sub[:-1])])
        self.sub, self.best = sub[self.first], np.maximum.reduceat(self.weight, self.first)
        self.last = np.r_[self.first[1:], len(term)]
        self.sub_start = np.searchsorted(term[self.first], np.arange(len(self.terms) + 1))
        by_label = np.lexsort((term, self.label))
        self.label_start = np.searchsorted(self.label[by_label], np.arange(len(self.ids) + 1))
        self.label_term, self.label_weight = term[by_label], self.weight[by_label]
        self.n_subs = int(sub.max()) + 1
        self.positive = bool((self.weight >= 0).all())
        # labels of the rarest terms: one without a common term proves that not all labels match
        spread = np.add.reduceat(np.diff(self.start)[self.label_term], self.label_start[:-1])
        probes = np.argsort(spread, kind="stable")[:PROBES]
        size = np.diff(self.label_start)[probes]
        self.probe_term = self.label_term[_runs(self.label_start[probes], self.label_start[probes + 1])]
        self.probe_start = np.r_[0, np.cumsum(size)[:-1]]

    def all_may_match(self, terms: np.ndarray) -> bool:
        """Whether every label may have one of ``terms``."""
        if int((self.start[terms + 1] - self.start[terms]).sum()) < len(self.ids):
            return False
        return bool(np.logical_or.reduceat(np.isin(self.probe_term, terms), self.probe_start).all())

    def known(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the block's terms in a list column of token hashes, by row and term."""
        size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = tokens.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        hit = self.terms[at] == flat
        key, count = np.unique(np.repeat(np.arange(len(tokens)), size)[hit] * len(self.terms) + at[hit], return_counts=True)
        return key // len(self.terms), key % len(self.terms), count

    def _scored(self, spots: np.ndarray, factor: np.ndarray):
        """(labels, scores, shared terms) from the postings of some (term, sub-block) spots."""
        a, b = self.first[spots], self.last[spots]
        at = _runs(a, b)
        labels, inverse = np.unique(self.label[at], return_inverse=True)
        return labels, np.bincount(inverse, self.weight[at] * np.repeat(factor, b - a)), np.bincount(inverse)

    def search(self, terms: np.ndarray, count: np.ndarray, k: int, kth: float, counts: dict | None = None):
        """(labels, scores, shared terms) of one record: at least all that reach ``kth`` and the
        block's best ``k``.  Sub-blocks whose bound, the sum of their maxima, stays below the
        k-th score are left, unless every label may match (then the lowest score matters)."""
        a, b = self.sub_start[terms], self.sub_start[terms + 1]
        spots, factor = _runs(a, b), np.repeat(count.astype(np.float64), b - a)
        if not self.positive or self.all_may_match(terms):
            return self._scored(spots, factor)
        sub = self.sub[spots]
        bound = np.bincount(sub, self.best[spots] * factor, self.n_subs)
        ahead = np.argsort(-bound, kind="stable")[:FIRST_SUBS]
        wave = np.zeros(self.n_subs, bool)
        wave[ahead[bound[ahead] >= kth - 2 * 10.0 ** -RANK_DECIMALS]] = True
        here = wave[sub]
        found = self._scored(spots[here], factor[here])
        if len(found[1]) >= k:
            kth = max(kth, float(np.partition(found[1], len(found[1]) - k)[len(found[1]) - k]))
        rest = ~wave & (bound >= kth * (1 - 1e-12) - 2 * 10.0 ** -RANK_DECIMALS) & (bound > 0)
        more = rest[sub]
        if counts is not None:
            counts["all"] = counts.get("all", 0) + int((self.last[spots] - self.first[spots]).sum())
            used = spots[here | more]
            counts["scored"] = counts.get("scored", 0) + int((self.last[used] - self.first[used]).sum())
        if not more.any():
            return found
        extra = self._scored(spots[more], factor[more])
        return tuple(np.concatenate([x, y]) for x, y in zip(found, extra))

    def candidates(self, key: np.ndarray, count: np.ndarray, row: np.ndarray, label: np.ndarray):
        """(score, shared terms) of given (row, label) pairs; ``key``: row * terms + term, sorted."""
        a, b = self.label_start[label], self.label_start[label + 1]
        at = _runs(a, b)
        pair = np.repeat(np.arange(len(label)), b - a)
        want = np.repeat(row, b - a) * len(self.terms) + self.label_term[at]
        place = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = key[place] == want if len(key) else np.zeros(len(want), bool)
        value = self.label_weight[at][hit] * count[place[hit]]
        return np.bincount(pair[hit], value, len(label)), np.bincount(pair[hit], minlength=len(label))


def _pack_block(table: pa.Table) -> pa.Table:
    block = LabelBlock(table.column("term").to_numpy(), table.column("id").to_pylist(), table.column("w").to_numpy())
    return pa.table({"block": table.column("block").slice(0, 1), "payload": pa.array([pickle.dumps(block, 5)], pa.binary())})


def label_blocks(index: Bm25Index) -> DataFrame:
    """``(block, payload)``: the postings in blocks of about ``BLOCK_POSTINGS``, built in tasks and
    written; a label lies in one block."""
    blocks = max(1, -(-index.n_postings // BLOCK_POSTINGS))
    dealt = index.postings.select(F.pmod(F.xxhash64(index.id_col), F.lit(blocks)).cast("int").alias("block"),
                                  F.xxhash64("term").alias("term"), F.col(index.id_col).alias("id"), "w")
    ship_package(index.postings.sparkSession)
    return written(dealt.groupBy("block").applyInArrow(_pack_block, "block int, payload binary"), "label-blocks")


def _merge_block(payload: bytes, names: list[str], k: int):
    def run(batches):
        block: LabelBlock = pickle.loads(payload)
        all_ids = pa.array(block.ids, pa.string())
        for batch in (b.slice(a, n) for b in batches for a, n in slices(b.column("_tok"))):
            n = batch.num_rows
            row, term, count = block.known(batch.column("_tok"))
            edge = np.searchsorted(row, np.arange(n + 1))
            cnt, mn, mx = (batch.column(c).to_pylist() for c in ("_cnt", "_mn0", "_mx0"))
            old = batch.column("_top")
            before = old.offsets.to_numpy()
            before, old = before - before[0], old.flatten()
            old_score, old_ids = old.field("score").to_numpy(zero_copy_only=False), old.field("id")
            picked, sizes = [], np.zeros(n, np.int64)
            for r in range(n):
                o = np.arange(before[r], before[r + 1])
                if edge[r] == edge[r + 1]:
                    picked.append((o, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                    sizes[r] = len(o)
                    continue
                own = slice(edge[r], edge[r + 1])
                kth = (mx[r] if not k else old_score[o[-1]] if len(o) >= k else None)
                labels, score, shared = block.search(term[own], count[own], max(k, 1), -np.inf if kth is None else kth)
                cnt[r] += len(labels)
                if len(labels):
                    mn[r] = float(score.min()) if mn[r] is None else min(mn[r], float(score.min()))
                    mx[r] = float(score.max()) if mx[r] is None else max(mx[r], float(score.max()))
                if k and len(labels) > k:
                    rounded = np.round(score, RANK_DECIMALS)
                    best = np.lexsort((labels, -rounded))[:k]  # labels are numbered by id
                    labels, score, shared = labels[best], score[best], shared[best]
                picked.append((o, labels, score, shared) if k else (o, labels[:0], score[:0], shared[:0]))
                sizes[r] = len(o) + (len(labels) if k else 0)
            top = _merged_top(old, old_ids, all_ids, picked, sizes, k)
            cand = _merged_candidates(batch, block, all_ids, row * len(block.terms) + term, count)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(cnt, pa.int64()), pa.array(mn, pa.float64()), pa.array(mx, pa.float64()), top, cand],
                [*names, "_cnt", "_mn0", "_mx0", "_top", "_cand"])
    return run


def _merged_top(old, old_ids, all_ids, picked, sizes, k: int) -> pa.Array:
    """The best ``k`` of the labels kept so far and of a block's, for all rows of a batch."""
    o, labels, score, shared = (np.concatenate([p[i] for p in picked]) if picked else np.zeros(0) for i in range(4))
    row = np.repeat(np.arange(len(picked)), sizes)
    # within a row: kept ones first, as they were concatenated
    is_old = np.concatenate([np.r_[np.ones(len(p[0]), bool), np.zeros(len(p[1]), bool)] for p in picked]) if picked else np.zeros(0, bool)
    total, common = np.empty(len(row)), np.empty(len(row), np.int64)
    total[is_old], total[~is_old] = old.field("score").to_numpy(zero_copy_only=False)[o.astype(np.int64)], score
    common[is_old], common[~is_old] = old.field("shared").to_numpy(zero_copy_only=False)[o.astype(np.int64)], shared
    place = np.empty(len(row), np.int64)
    place[is_old], place[~is_old] = o, labels + len(old_ids)
    ids = pa.concat_arrays([old_ids.cast(pa.string()), all_ids]).take(pa.array(place))
    names = np.array(ids.to_pylist(), object)
    rank = np.unique(names, return_inverse=True)[1] if len(names) else place
    order = np.lexsort((rank, -np.round(total, RANK_DECIMALS), row))
    start = np.r_[0, np.cumsum(sizes)]
    order = order[np.arange(len(order)) - np.repeat(start[:-1], sizes) < max(k, 0)] if len(order) else order
    kept = np.minimum(sizes, k)
    values = pa.StructArray.from_arrays([ids.take(pa.array(order.astype(np.int64))), pa.array(total[order]), pa.array(common[order])],
                                        fields=list(_TOP))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), values)


def _merged_candidates(batch, block, all_ids, key, count) -> pa.Array:
    """The scores of the candidates, those of this block's labels filled in."""
    state, asked = batch.column("_cand"), batch.column("_ids")
    offsets = state.offsets.to_numpy()
    values = state.values.slice(offsets[0], offsets[-1] - offsets[0])
    score, shared = (values.field(c).to_numpy(zero_copy_only=False).copy() for c in ("score", "shared"))
    if len(values):
        label = pc.index_in(asked.flatten(), value_set=all_ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        here = np.flatnonzero(label >= 0)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[here]
        score[here], shared[here] = block.candidates(key, count, row, label[here])
    filled = pa.StructArray.from_arrays([pa.array(score), pa.array(shared)], fields=list(_CAND))
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), filled)


def bm25_summary(queries: DataFrame, index: Bm25Index, text_col: str, k: int = 0, candidates=None,
                 keep_text: bool = True) -> DataFrame:
    """L2 / L3 without (record, label) rows: ``queries`` with, per record, the best ``k``
    labels (``_top``: id, score, shared in rank order), the scores of ``candidates`` (an array
    of label ids, ``_cand`` in the same order), and the number, minimum and maximum of the
    matching labels' scores (``_cnt, _mn0, _mx0``).  When labels were pruned, ``_cnt`` and
    ``_mn0`` cover the scored ones; then some label has no common term and the minimum over
    all labels is 0, as ``minmax_columns`` takes it.  ``keep_text=False`` leaves the text out of
    the result, so that it does not pass through the workers.

    Nothing is shuffled: label blocks are built in tasks and stored (``label_blocks``); each is
    sent to the tasks as one array of bytes, and records meet the blocks one after the other
    where they are, carrying their k-th score, minimum and maximum from block to block.  The
    state is written between blocks, so one block is held at a time.
    """
    ship_package(queries.sparkSession)
    keep = [c for c in queries.columns if keep_text or c != text_col]
    ids = candidates if candidates is not None else F.expr("cast(null as array<string>)")
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("shared"))
    tokens = F.transform(F.coalesce(whitespace_tokens(text_col), F.expr("cast(array() as array<string>)")), lambda t: F.xxhash64(t))
    df = queries.withColumns({"_tok": tokens, "_ids": F.coalesce(ids, F.expr("cast(array() as array<string>)"))}).withColumns({
        "_cnt": F.lit(0).cast("long"), "_mn0": F.lit(None).cast("double"), "_mx0": F.lit(None).cast("double"),
        "_top": F.expr("cast(array() as array<struct<id:string,score:double,shared:bigint>>)"),
        "_cand": F.transform(F.col("_ids"), lambda _: none)})
    df = df if keep_text else df.drop(text_col)
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stored = label_blocks(index)
    numbers = sorted(r["block"] for r in stored.select("block").collect())
    for i, b in enumerate(numbers):
        payload = bytes(stored.where(F.col("block") == b).first()["payload"])  # one block, bounded
        # tokens and asked ids leave the workers only for another block
        names = [*keep, "_tok", "_ids"] if i < len(numbers) - 1 else keep
        head = ", ".join(f"`{c}` {kind[c]}" for c in names)
        df = df.mapInArrow(_merge_block(payload, names, k), f"{head}, {_STATE}")
        if i < len(numbers) - 1:
            df = written(df, "block-state")
    return df.drop("_tok", "_ids")


def minmax_columns(n_labels: int):
    """(minimum, denominator) of the min-max scaling from the columns of ``bm25_summary``."""
    has_zero = F.col("_cnt") < F.lit(n_labels)
    mn = F.when(has_zero, F.least(F.coalesce("_mn0", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_mn0"))
    mx = F.when(has_zero, F.greatest(F.coalesce("_mx0", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_mx0"))
    return mn, mx - mn + F.lit(MINMAX_EPS)


def bm25_top_k(queries: DataFrame, index: Bm25Index, key: str, text_col: str, k: int) -> DataFrame:
    """L2 + W1 + L3: ``(key, <label id>, rank, score, bm25_scaled, _mn, _den)``, best first."""
    mn, den = minmax_columns(index.n_labels)
    s = bm25_summary(queries.select(key, text_col), index, text_col, k, keep_text=False).select(
        key, mn.alias("_mn"), den.alias("_den"), F.posexplode("_top").alias("_pos", "t"))
    return s.select(key, F.col("t.id").alias(index.id_col), (F.col("_pos") + 1).cast("int").alias("rank"),
                    F.col("t.score").alias("score"), ((F.col("t.score") - F.col("_mn")) / F.col("_den")).alias("bm25_scaled"),
                    "_mn", "_den")
