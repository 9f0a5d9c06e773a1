"""Sources and sinks (S4-S6, S10, S11, S13-S17), pluggable encoder and pair scorer."""

import json
import os

import numpy as np
import zstandard as zstd
from pyspark.sql import functions as F

from subjex.sources import sinks as K


def _records():
    return [{"id": "a", "title": " T1 ", "abstract": "A1", "language": "de", "type": "Book",
             "linsearch_codes": ["x", "y"], "gnd_subject_ids": ["1"]},
            {"id": "b", "title": "T2", "abstract": None, "language": "en", "type": "Article",
             "linsearch_codes": [], "gnd_subject_ids": []}]


def test_jsonl_zst_and_plain(spark, tmp_dir):
    lines = "\n".join(json.dumps(r) for r in _records()) + "\n\n"
    plain = os.path.join(tmp_dir, "c.jsonl")
    with open(plain, "w") as f:
        f.write(lines)
    zpath = os.path.join(tmp_dir, "c.jsonl.zst")
    with open(zpath, "wb") as f:
        f.write(zstd.ZstdCompressor(level=3).compress(lines.encode()))
    for p in (plain, zpath):
        df = K.read_jsonl(spark, p, partitions=4)
        assert sorted(r["id"] for r in df.collect()) == ["a", "b"]
    split = K.load_split(K.read_jsonl(spark, plain), ["title", "abstract"], "linsearch_codes")
    got = {r["id"]: (r["text"], r["labels"]) for r in split.collect()}
    assert got == {"a": ("T1 [SEP] A1", ["x", "y"]), "b": ("T2", [])}


def test_sinks_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, [0.1, 0.2], "train"), (2, [0.3, 0.4], "dev")],
                               "id INT, embedding ARRAY<DOUBLE>, split STRING")
    K.write_embeddings(df, os.path.join(tmp_dir, "emb"))
    assert [r["id"] for r in K.read_embeddings(spark, os.path.join(tmp_dir, "emb"), "dev").collect()] == [2]
    corpus = spark.createDataFrame([("a", "t")], "id STRING, title STRING")
    K.write_corpus(corpus, os.path.join(tmp_dir, "corpus_json"), fmt="json")
    assert spark.read.json(os.path.join(tmp_dir, "corpus_json")).count() == 1
    best = spark.createDataFrame([(1, 2, "g2", 0.5), (1, 1, "g1", 0.9)],
                                 "doc_id INT, rank INT, gnd_id STRING, score DOUBLE")
    K.write_subject_predictions(best, "doc_id", os.path.join(tmp_dir, "pred"))
    rec = spark.read.json(os.path.join(tmp_dir, "pred")).first()
    assert rec["id"] == "1" and rec["gnd_pred"] == ["g1", "g2"]
    pred = spark.createDataFrame([("a", [1, 0], [0.1234567, 0.9])],
                                 "id STRING, labels ARRAY<INT>, probs ARRAY<DOUBLE>")
    K.write_domain_predictions(pred, os.path.join(tmp_dir, "dom"))
    assert spark.read.json(os.path.join(tmp_dir, "dom")).first()["probs"] == [0.123457, 0.9]
    thr = spark.createDataFrame([(0, 0.3), (1, 0.6)], "class_idx INT, threshold DOUBLE")
    K.write_thresholds(thr, os.path.join(tmp_dir, "thr"))
    assert K.read_thresholds(spark, os.path.join(tmp_dir, "thr")).count() == 2
    assert K.metrics_path("out/metrics.json", "topk_minp", k=3, p_min=0.4) == "out/metrics_top3_p0.40.json"
    assert K.metrics_path("out/metrics.json", "global", thr=0.7) == "out/metrics_global0.70.json"


def test_model_save_load_and_custom_encoder(spark, tmp_dir):
    from subjex.operators.classify import OvrModel, embed, load_model, predict_proba, save_model
    model = OvrModel(np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([0.0, -np.inf]), 2)
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "class_idx INT, class STRING")
    save_model(model, classes, os.path.join(tmp_dir, "model"))
    m2, c2 = load_model(spark, os.path.join(tmp_dir, "model"))
    assert np.allclose(m2.coefficients, model.coefficients) and c2.count() == 2
    df = spark.createDataFrame([("x", [1.0, 1.0])], "t STRING, f ARRAY<DOUBLE>")
    p = predict_proba(df, "f", m2).first()["probs"]
    assert abs(p[0] - 1 / (1 + np.exp(-1))) < 1e-12 and p[1] == 0.0

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    out = embed(spark.createDataFrame([("abc",), ("a",)], "t STRING"), "t", make, dim=2).collect()
    v = np.array(out[0]["embedding"])
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and v[0] > v[1]


def test_custom_pair_scorer(spark):
    from subjex.operators.suggest import suggest_dense
    from subjex.plans import fixtures as fx
    docs = fx.record_vectors(spark, "/root/testdata/sf0.001")
    labels = fx.label_vectors(spark, "/root/testdata/sf0.001")

    def scorer(q, lab):  # a column-level pair scorer: longer labels first
        return F.length(lab).cast("double")
    out = suggest_dense(docs, "doc_id", "text", "embedding", labels, topk=5, rerank_n=2, scorer=scorer)
    rows = out.where(F.col("rank") == 1).collect()
    assert rows and all(r["score"] > 1.0 for r in rows)


def test_pq_reconstructs_with_enough_centroids(spark):
    from subjex.operators.neighbors import pq_encode, pq_top_k, train_pq
    from subjex.plans import fixtures as fx
    labels = fx.label_vectors(spark, "/root/testdata/sf0.01").select("gnd_id", "embedding")
    docs = fx.record_vectors(spark, "/root/testdata/sf0.01").select("doc_id", "embedding")
    book = train_pq(labels, "embedding", m=3, ksub=8)
    assert book.codebooks.shape == (3, 8, fx.VECTOR_DIM // 3)
    coded = pq_encode(labels, "embedding", book)
    codes = coded.select("codes").collect()
    assert all(len(r[0]) == 3 and all(0 <= c < 8 for c in r[0]) for r in codes)
    res = pq_top_k(docs, "doc_id", "embedding", coded, "gnd_id", book, 3)
    assert res.groupBy("doc_id").count().where("count <> 3").count() == 0


def test_rerank_keep_unranked_below(spark):
    from subjex.operators.suggest import rerank
    c = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3)],
                              "doc_id INT, gnd_id STRING, score DOUBLE, rank INT")
    pair = F.when(F.col("gnd_id") == "a", 0.1).otherwise(0.2)
    mixed = [r["gnd_id"] for r in rerank(c, "doc_id", 2, pair, 3).orderBy("rank").collect()]
    kept = [r["gnd_id"] for r in rerank(c, "doc_id", 2, pair, 3, keep_unranked_below=True)
            .orderBy("rank").collect()]
    assert mixed == ["c", "b", "a"] and kept == ["b", "a", "c"]


def test_hot_key_table_is_bounded(spark, monkeypatch):
    from subjex.operators import skew
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    rows = spark.range(1000).selectExpr("id as k", "cast(10 as bigint) as n")
    assert skew.hot_keys(rows, ["k"], rows_per_salt=1).count() <= 5


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest
    from types import SimpleNamespace
    from subjex.session import checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
