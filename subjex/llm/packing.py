"""Packing documents into token sequences: dominance reduction, then best fit.

Packing depends on lengths alone, so the instance is the histogram of piece lengths: at
most ``capacity`` counts, whatever the corpus.  On it, with multiplicities:

1. Reduction (Martello-Toth): for a piece j, largest first, the set {j, j*} with the
   largest fitting j* dominates every other bin with j when it fills the bin exactly, when
   only one piece fits beside j, or when at most two fit and no pair beats j*; {j} does
   when nothing fits.  When at most two fit and the best pair is j* with the largest piece b
   that fits beside both, {j, j*, b} dominates unless two pieces longer than b fit beside j.
   Such bins are fixed and leave; repeat until none is left.
2. Best fit decreasing packs the rest, each length into the fullest bins that take it.

The plan is a list of segments "pieces number a to b of length L go, q to a bin, to the
bins from s on at offset o"; its size is bounded by the capacity.  Pieces are numbered
within their length by distributed counts and find their segment by binary search.

Defined results: a null text is an empty document (the end id alone); repeated rows are
packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import ranked
from subjex.session import written

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 600_000
#: A full stop or comma that does not follow a letter or digit may belong to a longer run.
_RUN = re.compile(r"[.,](?<![^\W_][.,])")
#: ASCII punctuation but the apostrophe, which may begin a pre-token of letters.
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class Encoder:
    """Token ids of texts as little-endian bytes, by way of a bounded word cache.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words in turn.  New words of letters only are encoded many at a time as one
    text and cut at the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of letters: each is one pre-token, so its last token alone ends a word."""
        out = []
        for i in range(0, len(words), 512):
            some = words[i:i + 512]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                out += self._encode([w.decode() for w in some])
                continue
            raw = ids.tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words.  A run of punctuation after letters is a pre-token of its own."""
        plain = [w for w in words if w.isalpha() and w.islower()]  # ASCII
        new = dict(zip(plain, self._encode_letters(plain)))
        parts, need = {}, set()
        for w in words:
            if w in new:
                continue
            core, tail = w, b""
            if b"<|" not in w:
                core = w.rstrip(PUNCTUATION)
                if not core or core == w or not core.decode().lower()[-1].isalpha():
                    core = w
                tail = w[len(core):]
                if core.isascii():
                    core = core.lower()
            parts[w] = core, tail
            need.update((core, tail) if tail else (core,))
        letters, other = [], []
        for w in need:
            if w not in self.cache and w not in new:
                s = w.decode()
                whole = s.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", s) and s.lower().isalpha())
                (letters if whole else other).append(w)
        new.update(zip(letters, self._encode_letters(letters)))
        new.update(zip(other, self._encode([w.decode() for w in other])))
        known = lambda w: new[w] if w in new else self.cache[w]
        for w, (core, tail) in parts.items():
            new[w] = known(core) + known(tail) if tail else known(core)
        return new

    @staticmethod
    def _fewer_forms(text: str) -> bytes:
        """The text with ASCII letters in lower case and single full stops and commas set
        apart, where that cannot change its tokens: fewer distinct words to learn."""
        raw = text.encode()
        if "<|" in text:
            return raw
        low = raw.lower()
        plain = low.decode()
        if len(raw) != len(text) and not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", plain)):
            return raw
        if _RUN.search(plain):
            return low
        return low.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self._fewer_forms(t or "").split() for t in texts]
        new = self._learn(set(chain.from_iterable(split)) - self.cache.keys())
        if len(self.cache) < CACHED_WORDS:
            self.cache.update(new)
            return [b"".join(map(self.cache.__getitem__, words)) for words in split]
        both = _Over(new, self.cache)
        return [b"".join(map(both.__getitem__, words)) for words in split]


class _Over(dict):
    def __init__(self, first, rest):
        super().__init__(first)
        self.rest = rest

    def __missing__(self, key):
        return self.rest[key]


_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        where = str(path or tokenizer_path())
        encoder = _ENCODERS.get(where) or _ENCODERS.setdefault(where, Encoder(where))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut), *[cut] * with_ids))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut only documents longer than ``capacity``."""
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(_pieces(path, capacity, end_id, with_ids), shape)


class Plan:
    """Packing of a length histogram; ``segments``: (length, first, pieces, per bin, bin, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins, self.fixed = capacity, 0, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.total = self.left.copy()
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self._best_fit()

    def _put(self, length: int, bins: int, per_bin: int, first_bin: int, offset: int) -> None:
        first = int(self.total[length] - self.left[length])
        self.segments.append((length, first, bins * per_bin, per_bin, first_bin, offset))
        self.left[length] -= bins * per_bin

    def _smallest(self, skip: tuple[int, ...], n: int, above: int = 0) -> list[int]:
        """The ``n`` smallest pieces longer than ``above``, besides one of each length in ``skip``."""
        out: list[int] = []
        for length in np.flatnonzero(self.left[above + 1:]) + above + 1:
            have = int(self.left[length]) - skip.count(length)
            out += repeat(int(length), min(have, n - len(out)))
            if len(out) == n:
                break
        return out

    def _largest(self, skip: int, room: int) -> int:
        here = np.flatnonzero(self.left[:room + 1])
        if len(here) and here[-1] == skip and self.left[skip] < 2:
            here = here[:-1]
        return int(here[-1]) if len(here) else 0

    def _best_pair(self, skip: int, room: int) -> int:
        lengths = [int(x) for x in np.flatnonzero(self.left[:room + 1])]
        have = lambda x: int(self.left[x]) - (x == skip)
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            if a + b > room or have(b) < 1 + (a == b):
                j -= 1
            elif have(a) < 1:
                i += 1
            else:
                best = max(best, a + b)
                i += 1
        return best

    def _third(self, j: int, mate: int, room: int, best: int) -> int:
        """The piece that completes a dominating set {j, mate, b}, when at most two pieces fit
        beside j and the best pair sums to ``best``; 0 if there is none."""
        b = best - mate
        if not 0 < b <= mate or self.left[b] <= (j, mate).count(b):
            return 0
        longer = self._smallest((j, mate), 2, b)
        return b if len(longer) < 2 or sum(longer) > room else 0

    def _fix(self, pieces: list[int]) -> None:
        """As many bins with these pieces as there are."""
        kinds = {length: pieces.count(length) for length in pieces}
        n = min(int(self.left[length]) // k for length, k in kinds.items())
        offset = 0
        for length, k in kinds.items():
            self._put(length, n, k, self.bins, offset)
            offset += length * k
        self.bins += n
        self.fixed += n

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[j]:
                    room = self.capacity - j
                    mate = self._largest(j, room)
                    chosen = [j, mate] if mate else [j]
                    if mate and mate != room:
                        small = self._smallest((j,), 3)
                        if len(small) > 1 and small[0] + small[1] <= room:
                            if len(small) > 2 and sum(small) <= room:
                                break
                            best = self._best_pair(j, room)
                            if best > mate:
                                third = self._third(j, mate, room, best)
                                if not third:
                                    break
                                chosen.append(third)
                    self._fix(chosen)
                    changed = True

    def _best_fit(self) -> None:
        rooms: list[int] = []  # sorted free rooms that some bins have
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)

        def add(room, first, n):
            if n and room:
                if room not in groups:
                    groups[room] = []
                    insort(rooms, room)
                groups[room].append((first, n))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                i = bisect_left(rooms, length)
                if i == len(rooms):
                    room, first = self.capacity, self.bins
                    per = room // length
                    n = -(-int(self.left[length]) // per)
                    self.bins += n
                else:
                    room = rooms[i]
                    first, n = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[i]
                per, want = room // length, int(self.left[length])
                full = min(n, want // per)
                if full:
                    self._put(length, full, per, first, self.capacity - room)
                    add(room - per * length, first, full)
                rest = want - full * per
                if full < n and rest:
                    some = min(rest, per)
                    self._put(length, 1, some, first + full, self.capacity - room)
                    add(room - some * length, first + full, 1)
                    full += 1
                add(room, first + full, n - full)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces number ``rank`` of ``length``."""
        table = np.array(sorted(self.segments), np.int64).reshape(-1, 6)
        key = table[:, 0] * (1 << 48) + table[:, 1]
        s = table[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1]
        within = rank - s[:, 1]
        return s[:, 4] + within // s[:, 3], s[:, 5] + within % s[:, 3] * length


def _placed(plan: Plan, names: list[str]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset; ``ids``: the token ids as
    little-endian 32-bit bytes, if asked."""
    cut = written(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    plan = Plan(counts, capacity)
    numbered = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.mapInArrow(_placed(plan, cut.columns), f"{shape}, sequence_id long, offset long")
