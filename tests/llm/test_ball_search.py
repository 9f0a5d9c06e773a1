import math
import random
import re

import numpy as np
import pytest
from helpers import prose, table
from pyspark.sql import functions as F

from subjex.llm import ball_search as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    docs = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in wanted.items():
        scored = []
        for d, t in docs:
            if not t:
                continue
            m = 100 - 50 + ((50 * len(t) * n_docs) // length)
            score = 0
            for x in q & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(str(i), rank, str(d), -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def corpus():
    r = random.Random(3)
    texts = [prose(i, r.randrange(1, 150), 400) for i in range(300)] + [prose(5, 60, 400)] * 30  # ties
    texts += [None, "", "  ", "!!! ...", "W1-w2_W3", "ÄÖ äö w1ä", prose(9, 30_000, 400), "w7 " * 5000]
    docs = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[5]), (None, texts[5])]
    items = [(i, prose(1000 + i, 25, 400)) for i in range(12)] + [(90, prose(5, 60, 400)), (91, None), (92, "nowhere"), (93, "?!"),
                                                                  (None, "w1 W1 w2"), (94, "w3"), (94, "w4 w3"), (95, "äö")]
    return docs, items


@pytest.mark.parametrize("chunk, leaf, shard, per_pass", [(4096, 32, 1 << 13, 1 << 22), (50, 2, 40, 100)])
def test_against_brute_force(spark, monkeypatch, chunk, leaf, shard, per_pass):
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(B, "LEAF", leaf)
    docs, items = corpus()
    d = table(spark, docs).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(c) for c in ("rank", "number", "score", "t")})
    assert rows_of(B.rank_documents(d, i, 10, shard, per_pass)) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = table(spark, docs[:5]), spark.createDataFrame(items, "item_id long, text string")
    assert B.rank_documents(d, i.limit(0)).count() == 0
    assert B.rank_documents(d.limit(0), i).count() == 0


def vectors(seed, n, width, centers):
    """Sparse vectors around ``centers`` profiles: (row, term, value)."""
    r = np.random.default_rng(seed)
    profile = [r.choice(width, 30, replace=False) for _ in range(centers)]
    rows, cols = [], []
    for i in range(n):
        own = np.unique(np.r_[r.choice(profile[i % centers], 20), r.integers(0, width, 2)])
        rows.append(np.full(len(own), i))
        cols.append(own)
    row, term = np.concatenate(rows), np.concatenate(cols)
    return row, term, r.integers(1, 700_000, len(term))


def test_bounds_hold_and_prune():
    """Every bound is at least the best score below its node, and clustered vectors are pruned."""
    n, width = 3000, 500
    row, term, value = vectors(1, n, width, 40)
    weights = np.random.default_rng(2).integers(1, 9000, width)
    tree = B.BallTree(n, row, term, value, np.sqrt(weights / 1.0))
    scored = 0
    for seed in range(20):
        terms_ = np.sort(np.random.default_rng(seed + 50).choice(width, 12, replace=False)) if seed % 2 \
            else np.unique(term[row == seed])
        dense = np.zeros(width, np.int64)
        dense[terms_] = weights[terms_]
        exact = np.zeros(n, np.int64)
        np.add.at(exact, row, dense[term] * value)
        bound = tree.bounds(terms_, weights[terms_] / np.sqrt(weights[terms_] / 1.0))
        for node, (a, b) in enumerate(tree.own):
            assert bound[node] >= exact[tree.members[a:b]].max()
        best, counts = B.Best(5), {}
        B.search(tree, np.arange(n), (terms_, weights[terms_] / np.sqrt(weights[terms_] / 1.0), dense), best, counts)
        order = np.lexsort((np.arange(n), -exact))[:5]
        order = order[exact[order] > 0]
        assert best.doc.tolist() == order.tolist() and best.score.tolist() == exact[order].tolist()
        scored += counts["scored"] if not seed % 2 else 0
    assert scored < 10 * n * 0.8
