"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w . x) with ordered thresholds theta and one weight
vector shared by all grades; x marks the hashed words of the whole text (letters and digits
only, lower case), their beginnings of four and five bytes, and the level of a few ratios (symbols, capitals, repeats, length).  Scores
are the expected grade and the tail probability P(grade >= top).

Training takes a bounded sample: the ``max_rows`` labelled documents with the smallest
hash of their id (a documented parameter).  Marks in fewer than ``min_docs`` of them, or
whose documents' mean grade is not ``min_z`` standard errors under the sample's, keep
weight zero, and word weights stay at zero or below: words are evidence against a text, so
rare words are not learned by heart and the many common words of a long text do not
outweigh the telling ones.
Copies of one text would make its words look telling, so of the sampled documents of a
grade that share their smallest five-word hash one trains.  Scoring reads every whole text, row by row.

Defined results: a null or empty text has no words and is judged by its ratios; with fewer
than two grades in the sample every document gets the known grade (or the top one) and is
kept; labels of unknown documents and null grades are ignored; a document rated twice
trains twice; repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm import tokens as T
from subjex.llm.common import unnested

BITS = 40
MAX_ROWS = 12_000
MIN_DOCS = 5
MIN_Z = 3.5
PREFIXES = (4, 5)
BATCH_BYTES = 2 << 20
_U = np.uint64
#: Level bounds of the ratio features: per word, but capitals and symbols per byte.
LEVELS = {"symbols": (0.002, 0.01, 0.03, 0.08), "capitals": (0.01, 0.05, 0.15, 0.4), "digits": (0.005, 0.03, 0.1),
          "bangs": (0.001, 0.01, 0.05), "repeats": (0.2, 0.4, 0.6, 0.8, 0.95), "follows": (0.02, 0.1, 0.3, 0.6),
          "words": (5, 20, 50, 200, 1000, 5000), "length": (3.0, 4.5, 6.0, 9.0)}
_START = dict(zip(LEVELS, np.cumsum([0, *(len(b) + 1 for b in LEVELS.values())]).tolist()))
RATIOS = sum(len(b) + 1 for b in LEVELS.values())

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#*$%&|<>"]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[ord("!")] = 4


def _plain(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation and control bytes as zero bytes, which weigh nothing in a word's hash."""
    keep = np.zeros(256, bool)
    keep[128:] = keep[48:58] = keep[65:91] = keep[97:123] = True
    keep[[32, 9, 10, 11, 12, 13]] = True
    return np.where(keep[data], data, np.uint8(0))


def _beginnings(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes of each word; shorter words hash whole."""
    out, inside = np.full(len(starts), size, _U), np.ones(len(starts), bool)
    for i in range(size):
        byte = data[np.minimum(starts + i, len(data) - 1)]
        inside &= (starts + i < len(data)) & ~T._SPACE[byte]
        out = np.where(inside, T.pair(out, byte.astype(_U)), out)
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """(feature numbers, their number before each text): distinct marks of each text."""
    n = len(offsets) - 1
    starts, before = T.word_places(data, offsets)
    plain = _plain(data)
    words = T.word_hashes(plain, starts, lower=True, seed=5)
    count = np.diff(before)
    doc = np.repeat(np.arange(n), count)
    place = doc.astype(_U) << _U(BITS)
    key = np.unique(place | words >> _U(64 - BITS))
    owner = (key >> _U(BITS)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    low = np.where((plain >= 65) & (plain <= 90), plain + np.uint8(32), plain)
    key = np.r_[key, *(np.unique(place | _beginnings(low, starts, k) >> _U(64 - BITS)) for k in PREFIXES)]
    owner, feature = (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64)

    size = np.maximum(np.diff(offsets), 1)
    kind = _KIND[data]
    total = lambda k: np.diff(np.r_[0, np.cumsum(kind == k)][offsets])
    follows = np.zeros(len(words), np.int64)
    follows[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    some = np.maximum(count, 1)
    value = {"symbols": total(1) / size, "capitals": total(2) / size, "digits": total(3) / size, "bangs": total(4) / size,
             "repeats": 1 - distinct / some, "follows": np.bincount(doc, follows, n) / some, "words": count,
             "length": size / some}
    marks = np.stack([_START[k] + np.searchsorted(LEVELS[k], v, "right") for k, v in value.items()], axis=1)
    every = np.r_[marks.ravel(), feature + RATIOS]
    owner = np.r_[np.repeat(np.arange(n), len(LEVELS)), owner]
    order = np.argsort(owner, kind="stable")
    return every[order], np.searchsorted(owner[order], np.arange(n + 1))


def _marks(batches):
    for batch in batches:
        data, offsets = T.text_buffers(batch.column("text"))
        for i, j in T.slices(offsets, BATCH_BYTES):
            part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            marks, before = features(part, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade").slice(i, j - i), pa.array(_anchors(part, at)),
                 pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(marks))],
                ["grade", "anchor", "marks"])


def _anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest hash of five words in a row, the same for most near copies; texts
    without five words have one of their own bytes."""
    starts, before = T.word_places(data, offsets)
    runs = T.rolling(T.word_hashes(data, starts, lower=True), 5)
    n = np.diff(before)
    out = np.empty(len(n), np.int64)
    for i in range(len(n)):
        mine = runs[before[i]:before[i] + n[i] - 4] if n[i] > 4 else T.mix(data[offsets[i]:offsets[i + 1]].astype(_U))
        out[i] = mine.min().view(np.int64) if len(mine) else 0
    return out


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_arrays(marks: np.ndarray, before: np.ndarray, grade: np.ndarray, grades: int, min_docs: int = MIN_DOCS,
               min_z: float = MIN_Z, l2: float = 0.1, steps: int = 1500):
    """(marks, their weights, thresholds) by full-batch gradient descent with per-weight step sizes."""
    row = np.repeat(np.arange(len(grade)), np.diff(before))
    used, col = np.unique(marks, return_inverse=True)
    docs = np.bincount(col)
    centred = grade - grade.mean()
    z = np.bincount(col, centred[row]) / (max(centred.std(), 1e-9) * np.sqrt(docs))
    chosen = (docs >= min_docs) & (z <= -min_z) | (used < RATIOS)
    mine = chosen[col]
    row, col, used = row[mine], (np.cumsum(chosen) - 1)[col[mine]], used[chosen]
    share = np.bincount(grade, minlength=grades) / len(grade)
    theta = np.log(np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3) / np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1))
    # thresholds stay ordered: the first, then logarithms of the gaps
    free = np.r_[theta[0], np.log(np.maximum(np.diff(theta), 1e-2))]
    w, sum_w, sum_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(len(free), 1e-8)
    upper, lower = np.minimum(grade, grades - 2), np.maximum(grade - 1, 0)
    for _ in range(steps):
        gaps = np.exp(free[1:])
        theta = np.r_[free[0], free[0] + np.cumsum(gaps)]
        f = np.bincount(row, w[col], len(grade))
        up = np.where(grade < grades - 1, _sigmoid(theta[upper] - f), 1.0)
        low = np.where(grade > 0, _sigmoid(theta[lower] - f), 0.0)
        p = np.maximum(up - low, 1e-12)
        d_up = np.where(grade < grades - 1, up * (1 - up), 0.0) / p
        d_low = np.where(grade > 0, low * (1 - low), 0.0) / p
        slope = d_up - d_low  # of -log P by f
        g_w = np.bincount(col, slope[row], len(used)) + l2 * w
        g_theta = np.bincount(lower, d_low, grades - 1) - np.bincount(upper, d_up, grades - 1)
        g_free = np.r_[g_theta.sum(), np.cumsum(g_theta[::-1])[::-1][1:] * gaps]
        sum_w, sum_t = sum_w + g_w ** 2, sum_t + g_free ** 2
        w -= g_w / np.sqrt(sum_w)
        w[used >= RATIOS] = np.minimum(w[used >= RATIOS], 0.0)
        free = free - g_free / np.sqrt(sum_t)
    return used, w, np.r_[free[0], free[0] + np.cumsum(np.exp(free[1:]))]


def _fit(grades: int, min_docs: int):
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "grade")], axis=1)
        table = table.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1]))).combine_chunks()
        lists = table.column("marks").combine_chunks()
        grade = table.column("grade").to_numpy().astype(np.int64)
        before = lists.offsets.to_numpy()
        marks, weights, theta = fit_arrays(lists.values.to_numpy()[before[0]:before[-1]], before - before[0], grade, grades, min_docs)
        yield pa.RecordBatch.from_pydict({"marks": [marks.tolist()], "weights": [weights.tolist()], "theta": [theta.tolist()]})
    return run


def fit(docs: DataFrame, grades_of: DataFrame, grades: int, max_rows: int = MAX_ROWS, min_docs: int = MIN_DOCS):
    """(marks, weights, thresholds) from ``grades_of`` (doc_id, grade), or the one known grade.

    The model has at most a weight for each mark that ``min_docs`` of ``max_rows`` documents
    share and that passes the screening, some hundreds in practice.
    """
    rated = grades_of.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)
    # the sample's bound is max_rows, whatever the corpus
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_marks, "grade int, anchor long, marks array<long>")
    known = [r["grade"] for r in sample.select("grade").distinct().collect()]
    if len(known) < 2:
        return None, None, np.array([float(known[0] if known else grades - 1)])
    shape = "marks array<long>, weights array<double>, theta array<double>"
    # scan and marks stay parallel; only the sample's marks meet in the task that fits,
    # sorted, so that their order does not depend on the shuffle
    met = train.repartition(1).sortWithinPartitions("anchor", "grade", "marks")
    model = met.mapInArrow(_fit(grades, min_docs), shape).first()
    if model is None:
        return None, None, np.array([float(grades - 1)])
    return tuple(np.array(model[k]) for k in ("marks", "weights", "theta"))


def _score(known, weights, theta):
    def run(batches):
        for batch in batches:
            data, offsets = T.text_buffers(batch.column("text"))
            expected, tail = np.empty(batch.num_rows), np.empty(batch.num_rows)
            for i, j in T.slices(offsets, BATCH_BYTES):
                if weights is None:
                    expected[i:j], tail[i:j] = theta[0], 1.0
                    continue
                marks, before = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
                f = np.add.reduceat(np.where(known[at] == marks, weights[at], 0.0), before[:-1])
                over = 1 - _sigmoid(theta[None, :] - f[:, None])  # P(grade > k)
                expected[i:j], tail[i:j] = over.sum(axis=1), over[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(expected), pa.array(tail)],
                                             ["row", "expected_grade", "p_top"])
    return run


def scored_rows(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """``row`` (``columns`` of ``docs``), expected_grade and p_top = P(highest grade)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    shape = rows.drop("text").schema.add("expected_grade", "double").add("p_top", "double")
    return rows.mapInArrow(_score(*model), shape)


def score(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with expected_grade and p_top, which replace columns of these names."""
    return unnested(scored_rows(docs, model, columns), columns, expected_grade=F.col("expected_grade"), p_top=F.col("p_top"))


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings of the two labels: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2).alias("grade"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), expected_grade, p_top and
    ``kept``: P(sound and clean) >= threshold."""
    model = fit(docs, grades_from_labels(labels), 3, max_rows)
    return scored_rows(docs, model, docs.columns).withColumn("kept", F.col("p_top") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], threshold: float = 0.5,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """``columns`` of ``docs`` with expected_grade, p_top and ``kept``, which replace columns of
    these names; ``judge`` keeps them apart."""
    scored = scored_rows(docs, fit(docs, grades_from_labels(labels), 3, max_rows), columns)
    return unnested(scored, columns, expected_grade=F.col("expected_grade"), p_top=F.col("p_top"),
                    kept=F.col("p_top") >= threshold)
