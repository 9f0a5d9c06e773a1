"""Benchmark decontamination: BM25 over test items with block-max bounds, then overlap.

The index holds the test items; every passage of every document queries it.  A document is
read in passages of twice the longest item, each starting one item length after the last,
so a copied item lies whole in one passage.  An item is retrieved when its BM25 score for
the passage's distinct words reaches ``share`` of its score for itself; impacts are stored
divided by that threshold, so 1 is the bar for every item.

Bounds as in block-max WAND, computed for all passages of a batch at once.  Items are
numbered in blocks; a term keeps its largest impact in each block.  An item's most frequent
terms that together give it at most ``COMMON`` are not needed to find it: a block's bound is
the sum of the maxima of the passage's terms over the other postings, plus the most that
frequent terms give one of the block's items.  Only items of blocks whose bound reaches 1 are scored, with all terms.  No
retrieved item is capped.  Retrieved items are verified
on five-word shingles: ``containment`` (question and answer together) must reach 0.8, and
so must half of the question's or of the answer's shingles.  An item under five words is
verified as one shingle, its whole word sequence.

Words are lower-cased (all scripts) and end at white space and ASCII punctuation.

Document frequencies, the number of items and their mean length are counted over all items.
Items are cut into shards of at most about ``SHARD_BYTES`` of text, and only one shard at a
time is on the driver and sent to the tasks: each further shard is another pass over the
written rows, and changes no score.

Defined results: null or wordless texts match nothing, nor do null or wordless items; items of
equal text are all reported; repeated rows are judged alike; other columns pass through,
whatever their names (one named like the result is replaced by it).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm import tokens as T
from subjex.llm.common import nested, unnested
from subjex.session import written

SHINGLE = 5
SHARE = 0.5
MIN_CONTAINMENT = 0.8
#: Share of the question's or the answer's shingles that must be there as well.
MIN_PART = 0.5
K1, B = 1.2, 0.75
BLOCK = 4
COMMON = 0.5
SHARD_BYTES = 32 << 20
BATCH_BYTES = 1 << 20
_LEAK = "array<struct<item_id:long,bm25:double,containment:double,question_overlap:double,answer_overlap:double>>"


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): cut after the last question mark or before an answer mark; without
    either, the last fifth of the words (five at least) counts as the answer."""
    mark = re.search(r"\b(?:answer|antwort|réponse|respuesta)\s*:", text, re.I)
    at = mark.start() if mark else text.rfind("?") + 1
    if 0 < at < len(text.rstrip()):
        return text[:at], text[at:]
    words = text.split()
    n = max(SHINGLE, len(words) // 5)
    return " ".join(words[:-n]), " ".join(words[-n:])


_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation and control bytes as spaces."""
    return np.where(_WORD[data], data, np.uint8(32))


def _hashes(text: str) -> np.ndarray:
    data = _letters(np.frombuffer(text.encode(), np.uint8))
    starts, _ = T.word_places(data, np.array([0, len(data)]))
    return T.word_hashes(data, starts, lower=True)


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers start[i] to end[i] - 1 of all i in turn."""
    n = end - start
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


class Counts:
    """Statistics of all items: their number, mean length, and document frequency by term."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.df = n, mean, terms, df

    @staticmethod
    def of(items: list[tuple[int, str]]) -> "Counts":
        hashes = [h for _, text in items if text and len(h := _hashes(text))]
        terms, df = np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.zeros(0, np.uint64)]), return_counts=True)
        return Counts(len(hashes), float(np.mean([len(h) for h in hashes] or [0])), terms, df)


class Index:
    """Inverted index of one shard of items: impacts divided by each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, counts: Counts | None = None):
        rows = [(i, text, h) for i, text in items if text and len(h := _hashes(text))]
        counts = counts or Counts.of(items)
        self.ids = np.array([r[0] for r in rows], np.int64)
        if not rows:
            return
        lengths = np.array([len(h) for _, _, h in rows])
        self.width = int(lengths.max())
        owner = np.repeat(np.arange(len(rows)), lengths)
        pairs, tf = np.unique(np.stack([np.concatenate([h for _, _, h in rows]), owner.astype(np.uint64)]), axis=1, return_counts=True)
        self.vocab, term = np.unique(pairs[0], return_inverse=True)
        item = pairs[1].astype(np.int64)
        df = counts.df[np.searchsorted(counts.terms, self.vocab)]
        idf = np.log(1 + (counts.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / counts.mean))
        self.own = np.bincount(item, impact)
        self.threshold = share * self.own
        impact = impact / self.threshold[item]
        # postings by term: items and impacts; block maxima by term
        self.start = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        self.item, self.impact = item, impact
        # an item does not need its most frequent terms, as long as they give it at most COMMON
        order = np.lexsort((-df[term], item))
        given = np.cumsum(impact[order])
        edge = np.searchsorted(item[order], np.arange(len(rows) + 1))
        given -= np.repeat(np.r_[0, given[edge[1:-1] - 1]], np.diff(edge))
        spare = np.zeros(len(term), bool)
        spare[order] = given <= COMMON
        block = item // BLOCK
        self.blocks = int(block.max()) + 1
        self.frequent = np.zeros(self.blocks)
        np.maximum.at(self.frequent, np.arange(len(rows)) // BLOCK, np.bincount(item, np.where(spare, impact, 0.0), len(rows)))
        t, b, x = term[~spare], block[~spare], impact[~spare]
        at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1])])
        self.block, self.block_max = b[at], np.maximum.reduceat(x, at)
        self.block_start = np.searchsorted(t[at], np.arange(len(self.vocab) + 1))
        self.needed = np.diff(self.block_start) > 0
        self.shingles = []
        for _, text, whole in rows:
            parts = [whole, *(_hashes(p) for p in split_item(text))]
            sizes = [min(SHINGLE, len(h)) for h in parts]
            self.shingles.append(([np.unique(T.rolling(h, k)) if k else h for h, k in zip(parts, sizes)], sizes))

    def retrieve(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """(item, score / threshold) of the items in ``blocks`` that reach 1 for the distinct ``terms``."""
        at = _runs(self.start[terms], self.start[terms + 1])
        at = at[np.isin(self.item[at] // BLOCK, blocks)]
        score = np.bincount(self.item[at], self.impact[at])
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= 1 - 1e-9)]

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Share of the item's, its question's and its answer's shingles among ``words``."""
        here = lambda s, k: float(np.isin(s, T.rolling(words, k)).mean()) if len(s) else 0.0
        return tuple(here(s, k) for s, k in zip(*self.shingles[item]))

    def leaks(self, words: np.ndarray, before: np.ndarray, least: float):
        """(document, item, score, containment, question, answer) of a batch of documents."""
        n = np.diff(before)
        term = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        hits = np.flatnonzero(self.vocab[term] == words)
        term = term[hits]
        telling = self.needed[term]
        found, rare = hits[telling], term[telling]
        if not len(found):
            return
        doc = np.repeat(np.arange(len(n)), n)[found]
        at = found - before[doc]
        order = np.lexsort((at, rare, doc))
        last = np.full(len(found), -1)  # place of the same term earlier in the document
        same = (rare[order][1:] == rare[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        last[order[1:][same]] = at[order[:-1][same]]
        # passage k of a document covers words [k * width, (k + 2) * width)
        passages = np.maximum(-(-n // self.width) - 1, 1)
        first = np.r_[0, np.cumsum(passages)]
        k = at // self.width
        pairs, maxima = [], []
        for back in (0, 1):
            inside = np.flatnonzero((k >= back) & (k - back < passages[doc]) & (last < (k - back) * self.width))
            a, b = self.block_start[rare[inside]], self.block_start[rare[inside] + 1]
            spots = _runs(a, b)
            pairs.append(np.repeat(first[doc[inside]] + k[inside] - back, b - a) * self.blocks + self.block[spots])
            maxima.append(self.block_max[spots])
        pair, number = np.unique(np.concatenate(pairs), return_inverse=True)
        bound = np.bincount(number, np.concatenate(maxima)) + self.frequent[pair % self.blocks]
        pair = pair[bound >= 1 - 1e-9]
        able: dict[int, list[int]] = {}
        for x in pair.tolist():
            able.setdefault(x // self.blocks, []).append(x % self.blocks)
        best = {}
        for p, blocks in able.items():
            d = int(np.searchsorted(first, p, "right")) - 1
            x = before[d] + (p - first[d]) * self.width
            y = min(x + 2 * self.width, before[d + 1])
            i, j = np.searchsorted(hits, (x, y))
            for item, score in self.retrieve(np.unique(term[i:j]), np.array(blocks)):
                shares = self.verify(item, words[x:y])
                if shares[0] >= least and max(shares[1:]) >= min(MIN_PART, least) and shares > best.get((d, item), (0.0,))[1:]:
                    best[d, item] = (score * self.threshold[item], *shares)
        for (d, item), shares in sorted(best.items()):
            yield d, int(self.ids[item]), *shares


def _search(index: Index, least: float):
    """Leaks of one shard added to those of the rows (row, lower, leaks)."""
    shape = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in (
        "bm25", "containment", "question_overlap", "answer_overlap"))]))
    keys = [f.name for f in shape.value_type]

    def run(batches):
        for batch in batches:
            data, offsets = T.text_buffers(batch.column("lower"))
            leaks = batch.column("leaks").to_pylist()
            for i, j in T.slices(offsets, BATCH_BYTES):
                part = _letters(data[offsets[i]:offsets[j]])
                starts, before = T.word_places(part, offsets[i:j + 1] - offsets[i])
                for d, *leak in index.leaks(T.word_hashes(part, starts, lower=True), before, least):
                    leaks[i + d].append(dict(zip(keys, leak)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lower"), pa.array(leaks, shape)],
                                             ["row", "lower", "leaks"])
    return run


def _item_terms(batches):
    """(shard, length, distinct terms) of the items that have words."""
    for batch in batches:
        found = [(shard, h) for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist())
                 if len(h := _hashes(text))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([len(f[1]) for f in found], pa.int64()),
             pa.array([np.unique(f[1]).view(np.int64).tolist() for f in found], pa.list_(pa.int64()))], ["shard", "length", "terms"])


def find_leaks(docs: DataFrame, items: DataFrame, out: str = "leaks", share: float = SHARE,
               least: float = MIN_CONTAINMENT) -> DataFrame:
    """Add ``out``: the verified items of each row of ``docs`` (with ``text``); ``items``: item_id, text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    result = nested(docs, lower=F.lower("text"), leaks=F.expr(f"cast(array() as {_LEAK})"))
    if shards:
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
        terms = written(dealt.select("shard", "text").mapInArrow(_item_terms, "shard int, length long, terms array<long>"), "item-terms")
        n, mean = terms.agg(F.count("*"), F.avg("length")).first()
        each = terms.select("shard", F.explode("terms").alias("term"))
        frequency = written(each.groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    for k in range(shards):
        mine = each.where(F.col("shard") == k).select("term").distinct()
        known = frequency.join(mine, "term").orderBy("term").toArrow()  # one shard, bounded, as its texts are
        rows = dealt.where(F.col("shard") == k).select("item_id", "text").collect()
        if not known.num_rows:
            continue
        term = known.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        counts = Counts(n, mean, term[order], known.column("df").to_numpy()[order])
        index = Index([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))], share, counts)
        result = result.mapInArrow(_search(index, least), result.schema)
        if k < shards - 1:
            result = written(result, "leaks")
    return unnested(result, docs.columns, **{out: F.col("leaks")})
