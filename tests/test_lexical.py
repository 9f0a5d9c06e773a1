"""BM25 against a brute-force implementation of the Okapi formula."""

import math

from subjex.operators.lexical import (BM25_B, BM25_EPSILON, BM25_K1, bm25_scores, build_bm25,
                                      minmax_scale)
from subjex.plans import fixtures as fx
from testdata_paths import SF_SMALL


def brute_bm25(labels, query):
    corpus = [t.lower().split() for t in labels.values()]
    ids = list(labels)
    n = len(corpus)
    avgdl = sum(len(d) for d in corpus) / n
    df = {}
    for d in corpus:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    eps = BM25_EPSILON * sum(idf.values()) / len(idf)
    idf = {w: (eps if v < 0 else v) for w, v in idf.items()}
    out = {}
    for i, d in zip(ids, corpus):
        s = 0.0
        for q in query.lower().split():
            tf = d.count(q)
            s += idf.get(q, 0) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * len(d) / avgdl))
        out[i] = s
    return out


def test_bm25_equals_brute_force(spark):
    labels = fx.vocab(spark, SF_SMALL)
    lab = {r["gnd_id"]: r["label_text"] for r in labels.collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(25)
    index = build_bm25(labels)
    got = {}
    for r in bm25_scores(docs, index, "doc_id", text_col="text").collect():
        got[(r["doc_id"], r["gnd_id"])] = r["score"]
    scaled = {(r["doc_id"], r["gnd_id"]): r["bm25_scaled"]
              for r in minmax_scale(bm25_scores(docs, index, "doc_id", text_col="text"),
                                    "doc_id", index.n_labels).collect()}
    for d in docs.collect():
        ref = brute_bm25(lab, d["text"])
        mn, mx = min(ref.values()), max(ref.values())
        for gid, s in ref.items():
            assert abs(got.get((d["doc_id"], gid), 0.0) - s) < 1e-9
            if (d["doc_id"], gid) in scaled:
                assert abs(scaled[(d["doc_id"], gid)] - (s - mn) / (mx - mn + 1e-8)) < 1e-9


def test_salted_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    from subjex.operators import lexical as LX
    from subjex.operators import skew
    labels = fx.vocab(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    index = build_bm25(labels)
    fast = {(r[0], r[1]): r[2] for r in bm25_scores(docs, index, "doc_id", text_col="text").collect()}
    monkeypatch.setattr(LX, "MAX_BROADCAST_POSTINGS", 0)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", ("n", 3))
    salted = {(r[0], r[1]): r[2] for r in bm25_scores(docs, index, "doc_id", text_col="text").collect()}
    assert fast.keys() == salted.keys()
    assert all(abs(fast[k] - salted[k]) < 1e-9 for k in fast)


def test_blocked_scores_equal_the_joined_ones(spark, monkeypatch):
    """Top-k, statistics and candidate scores of the blocked form, in one and many blocks."""
    from subjex.operators import lexical as L
    from subjex.operators.ranking import top_k
    labels = spark.createDataFrame([(f"g{i}", " ".join(f"t{(i * j) % 17}" for j in range(1, 6))) for i in range(30)], "gnd_id string, label_text string")
    docs = spark.createDataFrame([(i, " ".join(f"T{(i + j) % 23}" for j in range(9))) for i in range(25)] + [(99, None), (98, ""), (97, "zz")], "id int, text string")
    index = L.build_bm25(labels)
    joined = top_k(L.bm25_scores(docs.where("text is not null"), index, "id", text_col="text"), "id", "gnd_id", "score", 4)
    want = {(r["id"], r["rank"]): (r["gnd_id"], round(r["score"], 9)) for r in joined.collect()}
    for size in (L.BLOCK_POSTINGS, 20):
        monkeypatch.setattr(L, "BLOCK_POSTINGS", size)
        got = {(r["id"], r["rank"]): (r["gnd_id"], round(r["score"], 9)) for r in L.bm25_top_k(docs, index, "id", "text", 4).collect()}
        assert got == want
        import pyspark.sql.functions as F
        s = L.bm25_summary(docs, index, "text", candidates=F.array(F.lit("g3"), F.lit("none"))).where("id = 99").first()
        assert s["_cnt"] == 0 and s["_mn0"] is None and [c["score"] for c in s["_cand"]] == [0.0, 0.0]


def test_block_maxima_prune_and_lose_nothing():
    """Pruned search against all scores: the best k agree, and most postings are left alone."""
    import numpy as np
    from subjex.operators.lexical import LabelBlock
    r = np.random.default_rng(5)
    rows = []
    for label in range(4000):
        for t in np.unique(np.r_[r.zipf(1.3, 4) % 3000, label % 200 + 5000]):
            rows.append((int(t), f"g{label:05d}", float(r.uniform(0.1, 1) * (0.2 if t < 50 else 3))))
    block = LabelBlock(np.array([x[0] for x in rows], np.int64), [x[1] for x in rows], np.array([x[2] for x in rows]))
    weight = {(t, g): w for t, g, w in rows}
    counts = {}
    for q in range(60):
        tokens = np.unique(np.r_[r.zipf(1.3, 30) % 3000, q % 200 + 5000])
        known = np.flatnonzero(np.isin(block.terms, tokens))
        count = r.integers(1, 4, len(known))
        labels, score, shared = block.search(known, count, 5, -np.inf, counts)
        want = {}
        for t, c in zip(block.terms[known], count):
            for g in set(x[1] for x in rows if x[0] == t):
                w, n = want.get(g, (0.0, 0))
                want[g] = (w + c * weight[t, g], n + 1)
        best = sorted(want.items(), key=lambda x: (-round(x[1][0], 9), x[0]))[:5]
        order = np.lexsort((labels, -np.round(score, 9)))[:5]
        got = [(block.ids[labels[i]], (round(float(score[i]), 9), int(shared[i]))) for i in order]
        assert got == [(g, (round(w, 9), n)) for g, (w, n) in best]
    print("share of postings scored", counts["scored"] / counts["all"])
    assert counts["scored"] < 0.7 * counts["all"]


def test_records_are_scored_some_tokens_at_a_time():
    """What a task holds does not grow with the rows of an Arrow batch or their lengths."""
    import pickle

    import numpy as np
    import pyarrow as pa
    r = np.random.default_rng(5)
    from subjex.operators import lexical as L
    block = L.LabelBlock(np.repeat(np.arange(50), 4), [f"g{i}" for i in range(200)], r.random(200))
    n = 300
    top, cand = pa.list_(L._TOP), pa.list_(L._CAND)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([list(r.integers(0, 60, 1000)) for _ in range(n)]), pa.array([["g3", "none"]] * n),
         pa.array([0] * n), pa.array([None] * n, pa.float64()), pa.array([None] * n, pa.float64()),
         pa.array([[]] * n, top), pa.array([[{"score": 0.0, "shared": 0}] * 2] * n, cand)],
        ["id", "_tok", "_ids", "_cnt", "_mn0", "_mx0", "_top", "_cand"])
    run = L._merge_block(pickle.dumps(block), ["id", "_tok", "_ids"], 3)
    parts = list(run([batch]))
    assert len(parts) > 3 and max(p.num_rows for p in parts) * 1000 <= 1 << 16
    alone = [p for i in range(n) for p in run([batch.slice(i, 1)])]
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(alone).to_pylist()


def test_tokens_stay_with_the_last_block(spark, monkeypatch):
    """Workers hand tokens on only to another block; the last one returns what is asked for."""
    from subjex.operators import lexical as L
    labels = spark.createDataFrame([(f"g{i}", f"a{i % 3} b{i % 5} c{i}") for i in range(12)], "gnd_id string, label_text string")
    docs = spark.createDataFrame([(i, f"a{i % 3} c{i} c{i + 1}") for i in range(9)] + [(None, "a1"), (4, None)], "id int, text string")
    got = []
    for size in (L.BLOCK_POSTINGS, 9):
        monkeypatch.setattr(L, "BLOCK_POSTINGS", size)
        s = L.bm25_summary(docs, L.build_bm25(labels), "text", k=2)
        plan = s._jdf.queryExecution().analyzed().toString()
        last = next(x for x in plan.splitlines() if "MapInArrow" in x).rsplit("[", 1)[1].split("]")[0]
        assert "_top" in last and "_tok" not in last, plan
        got.append(sorted((str(r["id"]), str(r["text"]), [t["id"] for t in r["_top"]]) for r in s.collect()))
    assert got[0] == got[1] and len(got[0]) == 11
