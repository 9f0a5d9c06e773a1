import collections
import hashlib
import random

import numpy as np
from helpers import WORD, prose, table

from subjex.llm import substrings


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_pack_round_trip():
    r = np.random.default_rng(1)
    for top in (1, 255, 256, 1 << 40, (1 << 64) - 1):
        v = r.integers(0, top, 100, dtype=np.uint64, endpoint=True)
        assert (substrings.unpack(substrings.pack(v), 100) == v).all()
    assert len(substrings.unpack(b"", 0)) == 0


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    passage = [prose(900 + i, 60, 10**6) for i in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(i, r.randrange(0, 90), 10**6)]
        for _ in range(r.randrange(3)):
            p = r.choice(passage).split()
            a = r.randrange(40)
            parts += [" ".join(p[a:a + r.randrange(10, 60)]), prose(5000 + i, r.randrange(0, 40), 10**6)]
        rows.append((i, "\n".join(parts)))
    rows += [(200, "ja " * 200), (201, prose(7, 40, 3)), (202, None), (203, ""), (204, " \t "), (205, "one two"), (None, rows[3][1]),
             (3, rows[3][1]), (206, prose(11, 20_000, 10**6) + " é " + passage[0]), (207, passage[0].upper()), (208, prose(12, 35, 10**6))]
    rows += [(300 + i, passage[5]) for i in range(80)]
    df = table(spark, rows)
    for window in (35, 8):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substrings.remove_repeats(df, window).collect())
        assert got == brute(rows, window)


def test_empty(spark):
    assert substrings.remove_repeats(table(spark, [])).count() == 0
    assert substrings.remove_repeats(table(spark, [(1, None)]), with_text=False).collect()[0]["n_words"] == 0
