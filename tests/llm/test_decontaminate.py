import random

import numpy as np
from helpers import prose, table

from subjex.llm import decontaminate as d


def test_split_item():
    assert d.split_item("What is it? A cat.") == ("What is it?", " A cat.")
    assert d.split_item("Name it.\nAnswer: cat") == ("Name it.\n", "Answer: cat")
    assert d.split_item("a b c d e f g h") == ("a b c", "d e f g h")


def test_bounds_lose_no_item():
    """Retrieval through bounds equals scoring every item for every passage."""
    r = random.Random(1)
    items = [(i, prose(i, r.randrange(5, 60), 400)) for i in range(120)]
    index = d.Index(items)
    texts = [prose(1000 + i, 300, 400) + " " + (items[i][1] if i % 3 else " ".join(items[i][1].split()[: 8])) for i in range(60)]
    for t in texts:
        h = d._hashes(t)
        got = {x[1] for x in index.leaks(h, np.array([0, len(h)]), 0.0)}
        want = set()
        for p in range(max(-(-len(h) // index.width) - 1, 1)):
            words = np.unique(h[p * index.width:(p + 2) * index.width])
            terms = np.flatnonzero(np.isin(index.vocab, words))
            want |= {i for i, _ in index.retrieve(terms, np.arange(index.blocks))}
        assert got == want and len(want) >= 1 - (h.size == 0)


def brute(rows, items):
    out = set()
    run = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for i, t in rows:
        have = run("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
        for k, x in items:
            need = run("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())
            if need and len(need & have) >= 0.8 * len(need):
                out.add((str(i), k))
    return out


def test_table_in_one_and_many_shards(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, prose(i, r.randrange(8, 50), 2000).capitalize() + ".") for i in range(50)]
    items += [(60, None), (61, ""), (62, "too short"), (63, items[0][1])]
    rows = []
    for i in range(80):
        t = prose(3000 + i, r.randrange(0, 400), 2000).split()
        if i % 2:
            x = items[r.randrange(50)][1]
            x = x.upper() if i % 3 == 0 else x
            at = r.randrange(len(t) + 1)
            t[at:at] = (x.split() if i % 5 else x.split()[: len(x.split()) // 2])
        rows.append((i, " ".join(t)))
    rows += [(90, None), (91, ""), (1, rows[1][1]), (None, "xx " + items[7][1]), (92, prose(9, 20_000, 2000) + " é, " + items[3][1])]
    docs, bench = table(spark, rows).drop("leaks"), table(spark, items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) > 25
    results = []
    for size in (d.SHARD_BYTES, 2000):
        monkeypatch.setattr(d, "SHARD_BYTES", size)
        got = d.find_leaks(docs, bench).collect()
        assert len(got) == len(rows) and got[0]["key"] == "key"
        found = {(str(x["doc_id"]), y["item_id"]) for x in got for y in x["leaks"]}
        assert found == want
        assert all(y["containment"] >= 0.8 and y["bm25"] > 0 for x in got for y in x["leaks"])
        results.append(sorted((str(x["doc_id"]), y["item_id"], round(y["bm25"], 9), y["containment"]) for x in got for y in x["leaks"]))
    assert results[0] == results[1]  # scores are the same for any shard size
    assert d.find_leaks(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert d.find_leaks(docs.limit(0), bench).count() == 0


def test_short_items_by_their_whole_sequence(spark):
    items = [(1, "Quoth the raven."), (2, "nevermore"), (3, "one two three four"), (4, "??"), (5, prose(7, 30, 2000))]
    rows = [(1, "he said: quoth THE raven, twice"), (2, "the raven quoth"), (3, "Nevermore!"), (4, "one two three four"), (5, "one two three"),
            (6, prose(7, 30, 2000) + " quoth the raven"), (7, "")]
    got = d.find_leaks(table(spark, rows).drop("leaks"), table(spark, items, "item_id long, text string")).collect()
    assert {(r["doc_id"], x["item_id"]) for r in got for x in r["leaks"]} == {(1, 1), (3, 2), (4, 3), (6, 5), (6, 1)}
