import random
import struct
import zlib

import numpy as np
from helpers import prose, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from subjex.llm import packing

ODD = ["", " ", "Don't you'll <|endoftext|>x A.B, naïve!! ﬁx İstanbul 12,5% 'S ẞ ét H̱a Σας ΟΔΟΣ.  x y z\u0085q\x1cw ''' ,.;'s ١٢ ñ*** ÉÈ!!",
       "<|StartOfText|> 中文字, 🙂! a.. b ., c … d. ”. e_. f.\ng,\nÉ. ñ, H̱. x don'.. it's. 'tis, a., <| |>", "A" * 300, "x." * 50, "!!! ... ,,,", "9.5. 3,4, a1b2. é1."]


def test_encoder_equals_the_tokenizer():
    model = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path())
    r = random.Random(1)
    alphabet = "abcXYZ éÉßñ.,!'’*|<>#12 \n\t İΣ-_̱́中🙂"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(600)]
    for some in (texts, texts[::-1]):
        for t, got in zip(some, encoder.encode(some)):
            ids = model.encode(t, add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids), t


def test_encoder_beyond_its_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = [prose(i, 30) for i in range(20)]
    first = [encoder.encode([t])[0] for t in texts]
    assert first == encoder.encode(texts) == packing.Encoder(packing.tokenizer_path()).encode(texts)


def fill(counts, capacity):
    """All pieces placed by the plan, checked: none overlaps, none sticks out."""
    plan = packing.Plan(counts, capacity)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, int)
    if not len(length):
        return plan, 0
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    start = np.r_[True, s[1:] != s[:-1]]
    assert (o[start] == 0).all() and (o[~start] == (o + n)[:-1][~start[1:]]).all() and (o + n).max() <= capacity
    assert len(set(s.tolist())) == plan.bins == s.max() + 1
    return plan, plan.bins


def fewest(lengths, capacity):
    """Optimum by exhaustive search."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1:])
        go(i + 1, rooms + [capacity - lengths[i]])
    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_instances_are_near_the_optimum(lengths):
    lengths.sort(reverse=True)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = fill(counts, 20)
    assert fewest(lengths, 20) <= bins <= fewest(lengths, 20) + 1
    if plan.fixed == plan.bins:  # all bins fixed by dominance: provably optimal
        assert bins == fewest(lengths, 20)


def test_sets_of_three_are_fixed():
    """Instances in which only the three-piece set dominates."""
    plan, bins = fill({10: 1, 6: 1, 4: 1}, 20)
    assert (plan.fixed, bins) == (1, 1)
    plan, bins = fill({11: 3, 5: 3, 4: 3}, 20)
    assert (plan.fixed, bins) == (3, 3)
    plan, bins = fill({9: 1, 6: 1, 4: 2}, 20)  # 6 + 4 beside 9; the other 4 goes alone
    assert (plan.fixed, bins) == (2, 2)
    plan, bins = fill({8: 2, 6: 2}, 20)  # equal lengths: 8, 6, 6
    assert bins == 2
    # 10 + 7 + 2 against 10 + 5 + 4: two pieces longer than 2 fit, nothing is fixed for 10
    plan, _ = fill({10: 1, 7: 1, 5: 1, 4: 1, 2: 1}, 20)
    assert plan.fixed == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 11), min_size=3, max_size=9))
def test_every_fixed_bin_is_part_of_an_optimum(lengths):
    """What is fixed plus the optimum of what is left is the optimum of all."""
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.Plan.__new__(packing.Plan)
    plan.capacity, plan.bins, plan.fixed, plan.segments = 20, 0, 0, []
    plan.left = np.zeros(21, np.int64)
    for n, k in counts.items():
        plan.left[n] = k
    plan.total = plan.left.copy()
    plan._reduce()
    rest = [int(n) for n in np.flatnonzero(plan.left)[::-1] for _ in range(plan.left[n])]
    assert plan.fixed + (fewest(rest, 20) if rest else 0) == fewest(sorted(lengths, reverse=True), 20)


def test_large_histogram():
    r = random.Random(4)
    counts = {n: r.randrange(1, 400) for n in r.sample(range(1, 4097), 900)}
    plan, bins = fill(counts, 4096)
    bound = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert plan.fixed > 0 and bins <= bound * 1.02 + 1 and len(plan.segments) < 20_000
    assert fill({}, 4096)[1] == 0


def test_table(spark):
    model = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(i, prose(i, 10 * i + 1)) for i in range(40)] + [(100, None), (101, ""), (102, prose(3, 9000)), (5, prose(5, 51)), (None, "a b")]
    got = packing.pack(table(spark, rows), capacity=512, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, a, len(ids[a:a + 512]), zlib.crc32(struct.pack(f"<{len(ids[a:a + 512])}I", *ids[a:a + 512]))) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack(table(spark, [])).count() == 0
