import random

import numpy as np
import pytest
from helpers import prose, sets, table

from subjex.llm import near_dup


def brute(rows, percent):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((str(d), len(s[i]), str(least), d == least))
    return sorted(out)


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, block", [(32, 4096), (2, 7)])
def test_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(8)
    texts = [prose(i, r.randrange(1, 120)) for i in range(60)]
    for k in range(6):
        texts += family(r, prose(1000 + k, 150), 14, 9)  # chains around the threshold
    texts += [prose(1, 80).upper(), prose(1, 80), "a b c", "A b  c", "a b", None, "", " \n ", None, "ß é x", prose(77, 30_000)]
    ids = r.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[0], texts[0]), (None, "lone words of no one else at all"), (None, None)]
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"]), x["kept"]) for x in near_dup.near_duplicates(table(spark, rows), 85).collect())
    assert got == brute(rows, 85)


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_repeated_ids_with_different_texts_lose_no_link(spark, order):
    a, b = prose(1, 60), prose(2, 60)
    rows = [[(1, a), (1, b), (2, b + " tail")][i] for i in order] + [(None, prose(3, 60)), (9, prose(3, 60) + " x"), (8, "x " + prose(3, 60))]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows), 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 8, False), (9, 8, False), (8, 8, True)}


def test_empty(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_odd_sketches_estimate_high_similarities():
    """The distance of two sketches follows the sets' similarity, and the limit spares links."""
    r = np.random.default_rng(2)
    limit = near_dup.most_differing(85)
    for j in (0.95, 0.85, 0.3):
        distances = []
        for _ in range(60):
            union = r.integers(0, 1 << 63, 400, dtype=np.uint64)
            shared = int(400 * j)
            half = (400 - shared) // 2
            a, b = np.sort(np.r_[union[:shared + half]]), np.sort(np.r_[union[:shared], union[shared + half:]])
            sk = [near_dup._signatures(x, np.array([0, len(x)]))[1][0] for x in (a, b)]
            distances.append(sum(bin(int(x) & (2**64 - 1)).count("1") for x in sk[0] ^ sk[1]))
        mean = near_dup.SKETCH_BITS / 2 * (1 - (1 - 2 / near_dup.SKETCH_BITS) ** (2 * near_dup.SAMPLES * (1 - j)))
        assert abs(np.mean(distances) - mean) < 8
        assert max(distances) <= limit if j >= 0.85 else min(distances) > limit
