"""Exact blocked top-k against numpy; IVF with every cell probed equals exact search."""

import numpy as np
from pyspark.sql import functions as F

from subjex.operators.neighbors import build_ivf, exact_top_k, ivf_top_k
from subjex.plans import fixtures as fx
from testdata_paths import SF_MID

SF_LARGE = "/root/testdata/sf0.1"


def _brute(q, items, k):
    qi, qv = zip(*q)
    ii, iv = zip(*items)
    Q = np.array(qv, dtype=np.float64)
    I = np.array(iv, dtype=np.float64)
    Q /= np.linalg.norm(Q, axis=1, keepdims=True)
    I /= np.linalg.norm(I, axis=1, keepdims=True)
    S = Q @ I.T
    out = {}
    for r, qid in enumerate(qi):
        order = sorted(range(len(ii)), key=lambda c: (-round(S[r, c], 9), ii[c]))[:k]
        out[qid] = [ii[c] for c in order]
    return out


def _ranked(df, q, i):
    out = {}
    for r in df.orderBy(q, "rank").collect():
        out.setdefault(r[q], []).append(r[i])
    return out


def test_exact_topk_matches_numpy_and_blocks(spark):
    docs = fx.record_vectors(spark, SF_MID).select("doc_id", "embedding")
    labels = fx.label_vectors(spark, SF_MID).select("gnd_id", "embedding")
    ref = _brute([(r[0], r[1]) for r in docs.collect()], [(r[0], r[1]) for r in labels.collect()], 7)
    one = _ranked(exact_top_k(docs, "doc_id", "embedding", labels, "gnd_id", "embedding", 7),
                  "doc_id", "gnd_id")
    # tiny blocks force many query and item blocks
    many = _ranked(exact_top_k(docs, "doc_id", "embedding", labels, "gnd_id", "embedding", 7,
                               query_block=37, item_block=6), "doc_id", "gnd_id")
    assert one == ref
    assert many == ref


def test_ivf_all_cells_equals_exact(spark):
    docs = fx.record_vectors(spark, SF_MID).select("doc_id", "embedding")
    labels = fx.label_vectors(spark, SF_MID).select("gnd_id", "embedding")
    exact = _ranked(exact_top_k(docs, "doc_id", "embedding", labels, "gnd_id", "embedding", 5),
                    "doc_id", "gnd_id")
    index = build_ivf(labels, "gnd_id", "embedding", n_cells=4)
    approx_all = _ranked(ivf_top_k(docs, "doc_id", "embedding", index, 5, nprobe=4), "doc_id", "gnd_id")
    assert approx_all == exact
    partial = ivf_top_k(docs, "doc_id", "embedding", index, 5, nprobe=1)
    assert partial.count() > 0


def test_nearest_cells_match_numpy(spark):
    from subjex.operators.neighbors import nearest_cells
    docs = fx.record_vectors(spark, SF_MID).select("doc_id", "embedding")
    labels = fx.label_vectors(spark, SF_MID).select("gnd_id", "embedding")
    index = build_ivf(labels, "gnd_id", "embedding", n_cells=4)
    got = {r["doc_id"]: list(r["c"]) for r in
           docs.select("doc_id", nearest_cells("embedding", index.centers, 2).alias("c")).collect()}
    c = index.centers / np.linalg.norm(index.centers, axis=1, keepdims=True)
    for r in docs.collect():
        q = np.array(r["embedding"], dtype=np.float64)
        sims = np.round(c @ (q / np.linalg.norm(q)), 9)
        want = sorted(range(len(c)), key=lambda j: (-sims[j], j))[:2]
        assert got[r["doc_id"]] == want


def test_stored_index_equals_exact_with_all_cells(spark, tmp_dir):
    from subjex.operators.label_index import LabelIndex, build_label_index
    docs = fx.record_vectors(spark, SF_MID).select("doc_id", "embedding")
    labels = fx.label_vectors(spark, SF_MID)
    build_label_index(labels, n_cells=3, m=2, ksub=8).save(tmp_dir + "/index")
    index = LabelIndex.load(spark, tmp_dir + "/index")
    assert index.book.codebooks.shape == (2, 8, fx.VECTOR_DIM // 2) and index.labels.count() == labels.count()
    coded = index.search(docs, "doc_id", "embedding", 4, nprobe=1)
    assert coded.count() > 0
    index.book = None
    exact = _ranked(exact_top_k(docs, "doc_id", "embedding", labels, "gnd_id", "embedding", 4), "doc_id", "gnd_id")
    assert _ranked(index.search(docs, "doc_id", "embedding", 4, nprobe=3), "doc_id", "gnd_id") == exact


def test_ties_are_cut_in_the_block(spark):
    from subjex.operators.neighbors import _topk_block_fn
    import pandas as pd
    items = pd.DataFrame({"i": [f"{j:04d}" for j in range(300)][::-1], "_iv": [[0.0, 0.0]] * 300})
    queries = pd.DataFrame({"q": range(4), "_qv": [[0.0, 0.0]] * 4})
    got = _topk_block_fn(10, True, "q", "i")(queries, items)
    assert len(got) == 40 and sorted(set(got["i"])) == [f"{j:04d}" for j in range(10)]


def _recall(spark, name, sf_dir, k=10):
    """Share of the exact neighbours (a row itself left out) found, over the rows with id divisible by 50."""
    import __spark_entry__ as E
    queries, items = fx.stored_vectors(spark, sf_dir)
    some = F.col("vec_id") % 50 == 0
    others = some & (F.col("vec_id") != F.col("neighbor_id"))
    exact = exact_top_k(queries.where(some), "vec_id", "embedding", items, "neighbor_id", "embedding", k).where(others)
    found = E.queries()[name](spark, sf_dir)
    assert found.select("vec_id").distinct().count() == queries.count() and found.count() == k * queries.count()
    want = {(r[0], r[1]) for r in exact.select("vec_id", "neighbor_id").collect()}
    got = {(r[0], r[1]) for r in found.where(others).select("vec_id", "neighbor_id").collect()}
    return len(want & got) / len(want)


def test_ivf_query_searches_all_stored_vectors(spark):
    assert len(fx.stored_vectors(spark, SF_LARGE)[0].first()["embedding"]) == 64
    assert _recall(spark, "v3_ivf_topk", SF_LARGE) >= 0.9


def test_pq_query_finds_the_neighbours(spark):
    assert _recall(spark, "v4_pq_topk", SF_LARGE) >= 0.9


def test_stored_codes_find_the_dense_candidates(spark):
    from subjex.functions.text import retrieval_query_text
    from subjex.plans.q_io import _subject_index
    records, index, encoder = _subject_index(spark, SF_LARGE)
    some = records.where(F.col("doc_id") % 50 == 0).select("id", retrieval_query_text("title", "abstract").alias("t"))
    docs = encoder.transform(some, "t", "v").select("id", "v")
    exact = exact_top_k(docs, "id", "v", index.labels, "gnd_id", "embedding", 20)
    want = {(r[0], r[1]) for r in exact.select("id", "gnd_id").collect()}
    got = {(r[0], r[1]) for r in index.search(docs, "id", "v", 20, nprobe=2).select("id", "gnd_id").collect()}
    print("recall", len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want)


def test_first_cut_keeps_every_score_that_may_count():
    from subjex.operators.neighbors import near_best
    r = np.random.default_rng(4)
    for n, k in ((5, 10), (40, 3), (1000, 10), (3000, 10)):
        s = np.round(r.random((20, n)), 2)  # many ties
        s[r.random(s.shape) < 0.1] = -np.inf
        s[0] = -np.inf
        rows, cols = near_best(s, k)
        assert np.isfinite(s[rows, cols]).all() and (np.diff(rows) >= 0).all()
        for i in range(20):
            mine = s[i][np.isfinite(s[i])]
            want = np.flatnonzero(np.isfinite(s[i]) & (s[i] >= np.sort(mine)[-min(k, len(mine)):].min(initial=np.inf)))
            assert set(want) <= set(cols[rows == i])


def test_blocks_stay_in_arrow(spark):
    """Workers search blocks without pandas: its import and the frames' copies are memory of every worker."""
    import subprocess
    import sys
    loaded = subprocess.run([sys.executable, "-c", "import subjex.operators.blocks, sys; print('pandas' in sys.modules)"],
                            capture_output=True, text=True, cwd="/", env={"PYTHONPATH": ":".join(p for p in sys.path if p)})
    assert loaded.stdout.strip() == "False", loaded.stderr
    docs = fx.record_vectors(spark, SF_MID).select("doc_id", "embedding")
    labels = fx.label_vectors(spark, SF_MID).select("gnd_id", "embedding")
    plan = exact_top_k(docs, "doc_id", "embedding", labels, "gnd_id", "embedding", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInPandas" not in plan and "CoGroupsInArrow" in plan


def test_hybrid_suggestion_needs_no_pandas(spark):
    """h2_hybrid_suggest from the vectors to the ranks: every worker step takes Arrow batches."""
    import __spark_entry__ as E
    from testdata_paths import SF_SMALL
    plan = E.queries()["h2_hybrid_suggest"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "InArrow" in plan and "InPandas" not in plan


def test_records_meet_labels_in_small_partitions(spark):
    """An Arrow batch ends with its partition, so what a lexical worker holds does not grow with the rows."""
    from subjex.operators import suggest as S
    docs = spark.range(50000).selectExpr("id doc_id", "concat('a', id % 7, ' b') text", "array(id % 5, 1.0D) v")
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "v"))
    labels = spark.createDataFrame([(f"g{i}", f"a{i} c", [float(i), 2.0]) for i in range(4)], "gnd_id string, label_text string, embedding array<double>")
    cands = docs.select("doc_id").distinct().selectExpr("doc_id", "array(named_struct('gnd_id', 'g1', 'cosine', 0.5D)) _c")
    records = S._records(docs, "doc_id", "text", cands)
    sizes = records.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 50001 and sizes.max() < 1.2 * S.BATCH_ROWS
    hy = S.hybrid_scores(docs, "doc_id", "text", "v", labels, 1)
    assert hy.where("doc_id <> 3").count() == 2 * 49999 and hy.where("doc_id = 3").count() >= 4


def test_few_items_make_small_query_blocks(spark):
    """What a worker holds of the queries follows the items; neighbours stay the same."""
    import re
    q = spark.range(9000).selectExpr("id q", "array(id % 97, id % 89 + 1.0D) v")
    it = spark.range(5).selectExpr("cast(id as string) i", "array(id, 2.0D) v")
    small = exact_top_k(q, "q", "v", it, "i", "v", 2)
    blocks = re.search(r"(\d+)\) as int\) AS _qb", small._jdf.queryExecution().optimizedPlan().toString())
    assert int(blocks[1]) == 3
    want = exact_top_k(q, "q", "v", it, "i", "v", 2, query_block=700)
    assert small.count() == 18000 and small.exceptAll(want).count() == 0


def test_empty_blocks_null_ids_and_odd_values(spark):
    rows = [(i, [float(i % 3), 1.0, float("nan") if i == 4 else 0.6 if i == 2 else 0.5]) for i in range(9)]
    q = spark.createDataFrame(rows, "q int, v array<float>")
    it = spark.createDataFrame([(None if i == 2 else f"{i}", v) for i, v in rows if i != 4], "i string, v array<double>")
    want = exact_top_k(q.where("q <> 4"), "q", "v", it, "i", "v", 3)
    # a row a block: some blocks get no row by hash, on either side
    got = exact_top_k(q.where("q <> 4"), "q", "v", it, "i", "v", 3, query_block=1, item_block=1)
    key = lambda df: sorted((r["q"], r["rank"], str(r["i"])) for r in df.collect())
    assert len(key(want)) == 24 and key(got) == key(want)
    # a query with NaN has no neighbours and does not disturb the others
    assert key(exact_top_k(q, "q", "v", it, "i", "v", 3)) == key(want)
    assert exact_top_k(q, "q", "v", it.limit(0), "i", "v", 3).count() == 0


def test_vectors_must_have_one_length():
    import pyarrow as pa
    import pytest
    from subjex.operators.blocks import top_k_tables
    items = pa.table({"i": ["a", "b"], "_iv": pa.array([[1.0, 0.0], [0.0, 1.0]])})
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, 2.0], None], [[1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError):
            top_k_tables(1, True, "q", "i")(pa.table({"q": [0, 1], "_qv": pa.array(bad)}), items)
    parts = pa.concat_tables([pa.table({"q": [n], "_qv": pa.array([[float(n), 1.0]])}) for n in range(3)])
    assert top_k_tables(1, True, "q", "i")(parts, items).to_pydict()["i"] == ["b", "a", "a"]
