"""Exact removal of repeated word windows, by fixed-block anchors.

A window of 35 words holds exactly one block of 18 words that starts at a multiple of 18
in its document.  If the window also starts elsewhere, so does that block.  So:

1. index: the blocks at multiples of 18 (reference blocks); probes: every rolling window
   of 18 words.  Both meet by hash; a reference block with another occurrence is a hit.
2. extension: the windows around hits (those whose own reference block is a hit) meet by
   an 88-bit hash; a window that occurs again is a repeat, and runs of repeats are the
   maximal exact repeats.  Their words go.

Documents are dealt to groups of bounded size by a hash of id and text; the group's words
are numbered in a fixed order, so an answer is addressed by (group, word number).  A group
sends each distinct hash once, in sorted blobs by hash bucket: a passage in a third of all
documents is one entry per group, never a list of its places.  Nothing is emitted in pairs.
The texts are shuffled once, and the three passes over them share that exchange.

Defined results: null or wordless text has no words and removes none; texts shorter than
the window are kept whole; repeated rows repeat each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm import tokens as T

WINDOW = 35
GROUP_BYTES = 8 << 20
BUCKET_WORDS = 2_000_000
_U = np.uint64
_BLOB = "bucket long, g long, hashes binary, extra binary, places binary, n long, n_places long"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, as many as the largest needs."""
    if not len(values):
        return b""
    k = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
        out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=_U(0))


class _Group:
    """The words of a group of documents, in a fixed order."""

    def __init__(self, table: pa.Table):
        ids = pc.fill_null(table.column("doc_id"), -(1 << 63)).to_numpy()
        order = np.lexsort((table.column("h").to_numpy(), ids))
        self.table = table.take(pa.array(order))
        self.data, offsets = T.text_buffers(self.table.column("text"))
        self.starts, self.before = T.word_places(self.data, offsets)
        self.n = np.diff(self.before)
        self.first = np.repeat(self.before[:-1], self.n)  # of each word, the first word of its document
        self.end = np.repeat(self.before[1:], self.n)

    def words(self, seed: int = 0) -> np.ndarray:
        return T.word_hashes(self.data, self.starts, seed=seed)

    def inside(self, size: int) -> np.ndarray:
        """Word numbers at which a run of ``size`` words of one document starts."""
        return np.flatnonzero(np.arange(len(self.starts)) + size <= self.end)


def _blobs(g: int, hashes: np.ndarray, buckets: int, bits: int, extra: np.ndarray | None, at: np.ndarray, places: np.ndarray):
    """Rows of distinct sorted ``hashes`` (``bits`` wide) by bucket; ``places`` belong to the hashes number ``at``."""
    bucket = ((hashes >> _U(bits - 32)) * _U(buckets)) >> _U(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=_U))
    cut_at = np.searchsorted(at, cut)
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        i, j, x, y = cut[b], cut[b + 1], cut_at[b], cut_at[b + 1]
        other = pack(extra[i:j]) if extra is not None else pack(_gaps((at[x:y] - i).astype(_U)))
        rows.append((int(b), g, pack(_gaps(hashes[i:j])), other, pack(places[x:y]), int(j - i), int(y - x)))
    return rows


def _table(rows):
    names = ("bucket", "g", "hashes", "extra", "places", "n", "n_places")
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({k: pa.array(c, t) for k, c, t in zip(names, cols, types)})


def _answers(found: dict):
    """(g, places) rows."""
    return pa.table({"g": pa.array(list(found), pa.int64()),
                     "places": pa.array([pack(p) for p in found.values()], pa.binary()),
                     "n": pa.array([len(p) for p in found.values()], pa.int64())})


def _places(table: pa.Table) -> np.ndarray:
    parts = [unpack(r["places"], r["n"]) for r in table.select(["places", "n"]).to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, _U)).astype(np.int64)


def _index(window: int, buckets: int, bits: int):
    """Pass 1: distinct hashes of all rolling blocks, and the reference blocks among them."""
    size = (window + 1) // 2

    def run(table: pa.Table) -> pa.Table:
        group, g = _Group(table), table.column("g")[0].as_py()
        at = group.inside(size)
        if not len(at):
            return _table([])
        h = T.rolling(group.words(), size)[at] >> _U(64 - bits)
        distinct, counts = np.unique(h, return_counts=True)
        own = (at - group.first[at]) % size == 0
        number = np.searchsorted(distinct, h[own])
        again = counts[number] > 1
        rows = [(-1 - g, g, b"", b"", pack(at[own][again].astype(_U)), 0, int(again.sum()))] if again.any() else []
        number, place = number[~again], at[own][~again]
        order = np.argsort(number)
        return _table(rows + _blobs(g, distinct, buckets, bits, None, number[order], place[order].astype(_U)))
    return run


def _hits(table: pa.Table) -> pa.Table:
    """Reference blocks of a hash bucket that occur in another group."""
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:  # known in the group itself
        return _answers({r["g"]: unpack(r["places"], r["n_places"]) for r in rows})
    lists = [np.cumsum(unpack(r["hashes"], r["n"]), dtype=_U) for r in rows]
    every = np.sort(np.concatenate(lists))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    found = {}
    for r, hashes in zip(rows, lists):
        n = r["n_places"]
        at = np.cumsum(unpack(r["extra"], n), dtype=_U).astype(np.int64)
        mine = hashes[at]
        spot = np.searchsorted(again, mine)
        hit = (spot < len(again)) & (again[np.minimum(spot, len(again) - 1)] == mine) if len(again) else np.zeros(n, bool)
        if hit.any():
            found[r["g"]] = unpack(r["places"], n)[hit]
    return _answers(found)


def _windows(window: int, buckets: int):
    """Pass 2: the windows around hits, by 88 bits of hash."""
    size = (window + 1) // 2

    def run(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return _table([])
        group, g = _Group(table), table.column("g")[0].as_py()
        hit = np.zeros(len(group.starts) + window, bool)
        hit[_places(hits)] = True
        at = group.inside(window)
        first = group.first[at]
        at = at[hit[first + -(-(at - first) // size) * size]]
        if not len(at):
            return _table([])
        a = T.rolling(group.words(), window)[at]
        b = T.rolling(group.words(seed=1), window)[at] >> _U(40)
        order = np.lexsort((b, a))
        a, b, at = a[order], b[order], at[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        run_of = np.cumsum(fresh) - 1
        again = np.bincount(run_of)[run_of] > 1
        rows = [(-1 - g, g, b"", b"", pack(np.sort(at[again]).astype(_U)), 0, int(again.sum()))] if again.any() else []
        number = np.arange(int(fresh.sum()))
        return _table(rows + _blobs(g, a[fresh], buckets, 64, b[fresh], number, at[fresh].astype(_U)))
    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Windows of a hash bucket that occur in two groups or more."""
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:
        return _answers({r["g"]: unpack(r["places"], r["n_places"]) for r in rows})
    a = np.concatenate([np.cumsum(unpack(r["hashes"], r["n"]), dtype=_U) for r in rows])
    b = np.concatenate([unpack(r["extra"], r["n"]) for r in rows])
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    again = np.zeros(len(a), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    found, i = {}, 0
    for r in rows:
        mine = again[i:i + r["n"]]
        i += r["n"]
        if mine.any():
            found[r["g"]] = np.sort(unpack(r["places"], r["n"])[mine])
    return _answers(found)


def _cut(window: int, with_text: bool):
    """Pass 3: remove the words that repeated windows cover."""
    def run(table: pa.Table, repeats: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result([], with_text)
        group = _Group(table)
        turn = np.zeros(len(group.starts) + 1, np.int64)
        at = _places(repeats)
        np.add.at(turn, at, 1)
        np.add.at(turn, at + window, -1)
        gone = np.cumsum(turn)[:-1] > 0
        rows = []
        for i, (doc_id, text) in enumerate(zip(*(group.table.column(c).to_pylist() for c in ("doc_id", "text")))):
            words = (text or "").encode().split()
            mine = gone[group.before[i]:group.before[i + 1]]
            removed = int(mine.sum())
            kept = b" ".join(compress(words, ~mine) if removed else words)
            rows.append((doc_id, len(words), removed, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
        return _result(rows, with_text)
    return run


def _result(rows, with_text):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({k: pa.array(c, t) for k, c, t in zip(names, cols, types)})


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256 and, if asked, kept_text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, math.ceil(size / GROUP_BYTES))
    buckets = max(least, math.ceil(size / 4 / BUCKET_WORDS))
    bits = min(64, max(33, (size // 4).bit_length() + 10))
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "doc_id",
                        F.xxhash64("text").alias("h"), "text")
    answer = "g long, places binary, n long"
    hits = keyed.groupBy("g").applyInArrow(_index(window, buckets, bits), _BLOB) \
        .groupBy("bucket").applyInArrow(_hits, answer)
    repeats = keyed.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_windows(window, buckets), _BLOB) \
        .groupBy("bucket").applyInArrow(_repeats, answer)
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return keyed.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_cut(window, with_text), shape)
