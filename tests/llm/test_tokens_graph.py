import random

import numpy as np
import pyarrow as pa
from helpers import WORD

from subjex.llm import graph, tokens


def test_words_and_hashes():
    r = random.Random(1)
    texts = [None, "", "  ", "a", " a", "a ", "é b\x0bc", "x\x1cy"] + ["".join(r.choice("ab é\n\t\x0c") for _ in range(r.randrange(30))) for _ in range(300)]
    for column in (pa.array(texts, pa.string()), pa.chunked_array([texts[:5], texts[5:]], pa.string()), pa.array(["zz"] + texts).slice(1)):
        data, offsets = tokens.text_buffers(column)
        starts, before = tokens.word_places(data, offsets)
        words = [w for t in texts for w in WORD.findall(t or "")]
        assert np.diff(before).tolist() == [len(WORD.findall(t or "")) for t in texts]
        h = tokens.word_hashes(data, starts)
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_slabs_do_not_matter(monkeypatch):
    data, offsets = tokens.text_buffers(pa.array(["ab cd " * 500, "x" * 3000 + " ab"]))
    starts, _ = tokens.word_places(data, offsets)
    whole = tokens.word_hashes(data, starts)
    monkeypatch.setattr(tokens, "SLAB", 64)
    assert (tokens.word_hashes(data, starts) == whole).all() and whole[0] == whole[-1]
    data, offsets = tokens.text_buffers(pa.array(["Ab aB ÉÉ éé"]))
    low = tokens.word_hashes(data, tokens.word_places(data, offsets)[0], lower=True)
    assert low[0] == low[1] and low[2] != low[3]


def test_rolling():
    words = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 5, 18, 35):
        runs = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        h = tokens.rolling(words, k).tolist()
        assert len(set(zip(runs, h))) == len(set(runs)) == len(set(h))
    assert len(tokens.rolling(words[:3], 5)) == 0


def test_slices_cover_all():
    offsets = np.array([0, 5, 5, 100, 104, 108, 130])
    cuts = list(tokens.slices(offsets, 10))
    assert [i for i, _ in cuts] + [cuts[-1][1]] == [0, *[j for _, j in cuts]] and cuts[-1][1] == 6


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (7, 6)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for x in root:
        assert got.get(x, x) == find(x)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
