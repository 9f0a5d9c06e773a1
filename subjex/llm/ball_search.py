"""Exact ranked lexical search through sparse ball trees.

Every document is a sparse vector of integer term impacts over the terms of the items; an
item is a sparse vector of integer term weights, and a score is their inner product.

1. One pass over the texts counts each document's terms and the frequencies of those terms
   that some item holds.  Document count, total length and document frequencies come from
   all documents.
2. Tasks cut their vectors into chunks of ``CHUNK`` documents and build a ball tree over
   each: a node splits its documents at the median of their projection on the line between
   two far apart ones, down to ``LEAF`` documents, and keeps centroid and radius.
3. Each item searches a tree best-first.  A document x in a ball (centroid c, radius r)
   scores at most  q.c + |q_S| * r,  where q_S is the item on the support of c (components
   are not negative, so x - c is zero elsewhere).  A subtree whose bound is below the item's
   k-th score so far is pruned; equal bounds are kept for the sake of ties.  The k-th scores
   run on from chunk to chunk of a task.
4. Leaves are scored in 64-bit integers.  Each task hands on its best k per item, and a
   window picks the final ones.

The tree works on impacts scaled per term by sqrt(weight / deviation), which shrinks the
bound and cancels in the product.  Bounds are floating point: radius and product are raised
by ``SLACK``, far above their rounding error, so rounding never prunes a hit.

Items are searched in shards of at most ``SHARD_TERMS`` terms, which bounds what a task
holds; statistics cover all documents whatever the shard.

Terms are told apart by 64-bit hashes (an item term meets a wrong document term with a
chance of 5e-20 a pair).

Defined results: a null text has no term; an item without terms, or without a document above
0, returns nothing; rows of one item_id (null included) are one item, the union of their
terms; repeated document rows are ranked as separate documents, equal ones next to each
other; a null doc_id comes last among equal scores (2**63 - 1 stands for it inside); other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.llm import tokens as T
from subjex.session import ship_package, written

CHUNK, LEAF = 4096, 32
#: Distinct terms of the items searched in one pass; their centroids are dense in a task.
SHARD_TERMS = 1 << 13
#: Item terms on the driver in one pass.
PASS_TERMS = 1 << 22
BATCH_BYTES = 1 << 20
SLACK = 1e-6
_MASK = (1 << 64) - 1


def _term_bytes() -> np.ndarray:
    """Byte table: A-Z to lower case, every byte outside ``[0-9A-Za-z]`` and below 0x80 to a space."""
    lut = np.full(256, 32, np.uint8)
    lut[128:] = np.arange(128, 256)
    for a, b in ((48, 58), (97, 123)):
        lut[a:b] = np.arange(a, b)
    lut[65:91] = np.arange(97, 123)
    return lut


_LUT = _term_bytes()


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, the number of terms before each text)."""
    plain = _LUT[data]
    starts, before = T.word_places(plain, offsets)
    return T.word_hashes(plain, starts), before


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _item_terms(batches):
    for batch in batches:
        data, offsets = T.text_buffers(batch.column("text"))
        hashes, before = term_hashes(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), _lists(before, hashes.view(np.int64))],
                                         ["item_id", "terms"])


def _count_terms(known: np.ndarray):
    """Per document: number of terms, and the places in ``known`` (sorted) of its known terms
    with their frequencies."""
    def run(batches):
        for batch in batches:
            data, offsets = T.text_buffers(batch.column("text"))
            for i, j in T.slices(offsets, BATCH_BYTES):
                hashes, before = term_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                doc = np.repeat(np.arange(j - i), np.diff(before))[hit]
                pair, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
                own = np.searchsorted(pair, np.arange(j - i + 1) * len(known))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(before)),
                     _lists(own, (pair % len(known)).astype(np.int32)), _lists(own, tf.astype(np.int32))],
                    ["doc_id", "n", "term", "tf"])
    return run


class BallTree:
    """A tree over the rows of one chunk of sparse vectors (``row`` sorted, ``term``, ``value``).

    Nodes are numbered in level order, node 0 is the root; ``own[i]`` is the slice of
    ``members`` below node i.  ``scale`` multiplies each term's values.
    """

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray,
                 leaf: int = LEAF):
        self.first = np.searchsorted(row, np.arange(n + 1))
        self.term, self.value, width = term, value, len(scale)
        x = value * scale[term]
        norm = np.bincount(row, x * x, n)
        members, own, child = np.arange(n), [(0, n)], []
        centroids, radii = [], []
        i = 0
        while i < len(own):
            a, b = own[i]
            rows = members[a:b]
            at = spans(self.first, rows)
            t, v = term[at], x[at]
            local = np.repeat(np.arange(b - a), self.first[rows + 1] - self.first[rows])
            c = np.bincount(t, v, width) / (b - a)

            def product(p):
                return np.bincount(local, v * p[t], b - a)
            far = np.maximum(norm[rows] - 2 * product(c) + c @ c, 0.0)
            centroids.append(c)
            # the expansion cancels: its error is relative to the norms, not to the distance
            radii.append(math.sqrt(far.max() + 1e-12 * (norm[rows].max() + c @ c)))
            if b - a > leaf:
                p = self._dense(rows[int(far.argmax())], x, width)
                near_p = product(p)
                other = norm[rows] - 2 * near_p
                q = self._dense(rows[int(other.argmax())], x, width)
                side = np.argsort(product(q) - near_p, kind="stable")
                members[a:b] = rows[side]
                middle = (a + b) // 2
                child.append(len(own))
                own += [(a, middle), (middle, b)]
            else:
                child.append(0)
            i += 1
        self.members, self.own, self.child = members, own, child
        self.centroids, self.radii = np.array(centroids), np.array(radii)

    def _dense(self, row: int, x: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        a, b = self.first[row], self.first[row + 1]
        out[self.term[a:b]] = x[a:b]
        return out

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of the score below every node, for one item in scaled terms."""
        c = self.centroids[:, terms]
        reach = np.sqrt((c > 0) @ (weights * weights))
        return (c @ weights + reach * self.radii) * (1 + SLACK)

    def scores(self, node: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact integer scores) below a leaf; ``weights``: int64 per term."""
        a, b = self.own[node]
        rows = self.members[a:b]
        at = spans(self.first, rows)
        size = self.first[rows + 1] - self.first[rows]
        total = np.cumsum(np.r_[np.int64(0), weights[self.term[at]] * self.value[at]])
        end = np.cumsum(size)
        return rows, total[end] - total[end - size]


def spans(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The entries of the given rows, one row after the other."""
    size = first[rows + 1] - first[rows]
    skip = np.repeat(first[rows] - np.r_[0, np.cumsum(size)[:-1]], size)
    return np.arange(int(size.sum())) + skip


class Best:
    """The best ``k`` (score, document) of one item so far, ties by smaller document."""

    def __init__(self, k: int):
        self.k, self.doc, self.score, self.kth = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.kth
        if not keep.any():
            return
        doc, score = np.r_[self.doc, doc[keep]], np.r_[self.score, score[keep]]
        order = np.lexsort((doc, -score))[:self.k]
        self.doc, self.score = doc[order], score[order]
        if len(order) == self.k:
            self.kth = int(self.score[-1])


def search(tree: BallTree, docs: np.ndarray, item: tuple, best: Best, counts: dict | None = None) -> None:
    """Best-first search of one item (terms, integer weights, scaled weights, dense weights)."""
    terms, scaled, dense = item
    bound = tree.bounds(terms, scaled)
    heap = [(-bound[0], 0)]
    while heap:
        upper, node = heapq.heappop(heap)
        if -upper < best.kth:  # no node left can reach the k-th score
            break
        child = tree.child[node]
        if child:
            for c in (child, child + 1):
                if bound[c] >= best.kth:
                    heapq.heappush(heap, (max(-bound[c], upper), c))
        else:
            rows, score = tree.scores(node, dense)
            best.add(docs[rows], score)
            if counts is not None:
                counts["scored"] = counts.get("scored", 0) + len(rows)


#: Null document ids sort last.
_NO_ID = np.iinfo(np.int64).max


def _search_all(items: list, scale: np.ndarray, k: int, stats: tuple[int, int]):
    """Best ``k`` documents of every item over the vectors of one task.

    ``items``: (number, term places, integer weights); ``stats``: document count and total
    length of the collection.
    """
    n_docs, length = stats

    def run(batches):
        width = len(scale)
        prepared = []
        for number, terms, weights in items:
            dense = np.zeros(width, np.int64)
            dense[terms] = weights
            prepared.append((number, (terms, weights / scale[terms], dense), Best(k)))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                docs = part.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                n = part.column("n").to_numpy(zero_copy_only=False)
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
                row = np.repeat(np.arange(len(docs)), part.column("term").value_lengths().to_numpy(zero_copy_only=False))
                m = 50 + (50 * n * n_docs) // length
                tree = BallTree(len(docs), row, term, impact(tf, m[row]), scale, LEAF)
                for _, item, best in prepared:
                    search(tree, docs, item, best)
        for number, _, best in prepared:
            if len(best.doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.doc), number, np.int64)),
                     pa.array(best.doc, mask=best.doc == _NO_ID), pa.array(best.score)], ["number", "doc_id", "score"])
    return run


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m), the length-normalised frequency."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _shards(items: dict, most: int) -> list[list]:
    """Item numbers in runs of at most ``most`` distinct terms (a longer item alone)."""
    out, terms = [[]], set()
    for number, own in items.items():
        if out[-1] and len(terms | own) > most:
            out.append([])
            terms = set()
        terms |= own
        out[-1].append(number)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, shard_terms: int = SHARD_TERMS,
                   pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item
    (item_id, text), score above 0, ties by ascending doc_id.

    The term hashes of at most about ``pass_terms`` item terms are on the driver at a time:
    items are dealt by a hash of their id into as many passes as that takes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    hashed = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<long>")
    # an item without terms explodes to nothing
    per_item = written(hashed.select("item_id", F.explode("terms").alias("t")).groupBy("item_id")
                       .agg(F.collect_set("t").alias("t")), "item-terms")
    total = per_item.agg(F.sum(F.size("t"))).first()[0] or 0
    passes = -(-total // pass_terms)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for p in range(passes):
        rows = per_item.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        own = {i: {t & _MASK for t in r["t"]} for i, r in enumerate(rows)}
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"number long, item_id {kind}")
        for shard in _shards(own, shard_terms):
            best = _search_shard(texts, {i: own[i] for i in shard}, k)
            found.append(best.join(ids, "number").select("item_id", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(place))
    return best.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_shard(texts: DataFrame, own: dict[int, set], k: int) -> DataFrame:
    """(number, doc_id, score): at least the best ``k`` documents of the items of one shard."""
    known = np.array(sorted(set().union(*own.values())), np.uint64)
    vectors = written(texts.mapInArrow(_count_terms(known), "doc_id long, n long, term array<int>, tf array<int>"),
                      "term-vectors")
    n_docs, length = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    # one row per known term
    df = {r["t"]: r["c"] for r in vectors.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect()}
    counts = np.array([df.get(i, 0) for i in range(len(known))])
    weights = np.array([weight(n_docs, int(c)) for c in counts], np.int64)
    share = np.clip(counts / max(1, n_docs), 0.5 / max(1, n_docs), 1 - 0.5 / max(1, n_docs))
    scale = np.sqrt(np.maximum(weights, 1) / np.sqrt(share * (1 - share)))
    items = []
    for number, terms in own.items():
        at = np.searchsorted(known, np.array(sorted(terms), np.uint64))
        at = at[weights[at] > 0]
        items.append((number, at, weights[at]))
    return written(vectors.where(F.size("term") > 0).mapInArrow(
        _search_all(items, scale, k, (n_docs, length or 1)), "number long, doc_id long, score long"), "best-documents")
