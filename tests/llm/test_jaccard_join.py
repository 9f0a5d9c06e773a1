import random

import numpy as np
import pytest
from helpers import prose, sets, table

from subjex.llm import jaccard_join as J


def brute(rows, percent):
    """(doc_id, set size, component) by comparing every pair of rows."""
    s = [sets(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and s[i] and s[j]
            if same_id or (both and 100 * both >= percent * len(s[i] | s[j])):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((str(d), len(s[i]), str(min((x for x in groups[find(i)] if x is not None), default=None)))
                  for i, (d, _) in enumerate(rows))


def got(spark, rows, percent=85, bins=J.BINS):
    return sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"]))
                  for x in J.jaccard_join(table(spark, rows), percent, bins).collect())


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, block, bins", [(32, 4096, J.BINS), (2, 7, 16)])
def test_against_brute_force(spark, monkeypatch, small, block, bins):
    """Chains around the threshold; with 16 bins the orders are all but random."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    r = random.Random(8)
    line = prose(50, 40)  # a passage that many share
    texts = [prose(i, r.randrange(1, 120)) + (" " + line if i % 2 else "") for i in range(60)]
    for k in range(6):
        texts += family(r, prose(1000 + k, 150), 14, 9)
    texts += [prose(1, 80).upper(), prose(1, 80), "a b c", "A b  c", "a b", None, "", " \n ", None, "ß é x", prose(77, 30_000)]
    ids = r.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[0], texts[0]), (None, "lone words of no one else at all"), (None, None)]
    assert got(spark, rows, bins=bins) == brute(rows, 85)


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_repeated_ids_and_null_ids_link_whatever_the_row_order(spark, order):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, b + " tail")]
    rows = [rows[i] for i in order] + [(None, prose(3, 60)), (9, prose(3, 60) + " end"), (8, "end " + prose(3, 60)), (7, None)]
    assert got(spark, rows) == brute(rows, 85)


def test_empty(spark):
    assert J.jaccard_join(table(spark, [])).count() == 0
    assert got(spark, [(1, None), (2, "")]) == [("1", 0, "1"), ("2", 0, "2")]


def test_every_order_keeps_every_linked_pair():
    """Prefixes of sets at or above the threshold overlap under each order, whatever the counters."""
    r = np.random.default_rng(3)
    for percent in (50, 85, 90, 100):
        counter = r.integers(0, 50, J.BINS)
        for _ in range(60):
            n = int(r.integers(1, 300))
            union = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            a, b = (np.sort(r.permutation(union)[int(r.integers(0, 1 + len(union) * (100 - percent) // 200)):]) for _ in "ab")
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or not both:
                continue
            for m in range(J.ORDERS):
                pa_, pb_ = (J.prefixes(x, np.array([0, len(x)]), m, counter, percent)[0] for x in (a, b))
                assert len(np.intersect1d(pa_, pb_))


def test_orders_intersect(spark):
    """A pair that shares only a common passage passes single orders by chance, rarely all."""
    r = np.random.default_rng(5)
    counter = np.zeros((J.ORDERS, J.BINS), np.int64)
    passed = np.zeros((200, J.ORDERS), bool)
    for i in range(200):
        shared = r.integers(0, 1 << 63, 12, dtype=np.uint64)
        a, b = (np.unique(np.r_[shared, r.integers(0, 1 << 63, 188, dtype=np.uint64)]) for _ in "ab")
        for m in range(J.ORDERS):
            pa_, pb_ = (J.prefixes(x, np.array([0, len(x)]), m, counter[m], 85)[0] for x in (a, b))
            passed[i, m] = len(np.intersect1d(pa_, pb_)) > 0
    assert passed.all(axis=1).mean() < passed[:, 0].mean() * 0.8
