"""Late interaction and the encoder plug-in against plain loops."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from subjex.operators.encoders import LsaEncoder
from subjex.operators.pair_scorer import LateInteraction
from testdata_paths import SF_SMALL


def _plain(encoder, record, label):
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % len(encoder.idf)
    r, t = ({bucket(w) for w in (x or "").lower().split()} for x in (record, label))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    total = sum(max(encoder.idf[b], 0) for b in t)
    if not r or not total:
        return 0.0
    match = lambda b: 1.0 if b in r else max(0.0, max(float(unit(encoder.projection[b]) @ unit(encoder.projection[x])) for x in r))
    return sum(max(encoder.idf[b], 0) * match(b) for b in t) / total


def test_scores_equal_a_plain_loop(spark):
    rows = [(f"a{i % 5} b{i % 7} c{i % 3} common", f"a{i % 4} d{i % 6}") for i in range(40)] + [(None, "a1"), ("a1", None), ("", ""), ("a1 A1", "a1")]
    df = spark.createDataFrame(rows, "r string, t string").repartition(3)
    encoder = LsaEncoder.fit(df.select(F.concat_ws(" ", "r", "t").alias("x")), "x", dim=5, buckets=128)
    scorer = LateInteraction(encoder)
    got = df.withColumn("s", scorer(F.col("r"), F.col("t"))).collect()
    assert all(abs(x["s"] - _plain(encoder, x["r"], x["t"])) < 1e-9 for x in got)
    assert [x["s"] for x in got if x["r"] == "a1 A1"] == [1.0]


def test_rerank_scores_only_the_first_pairs(spark):
    import __spark_entry__ as E
    from subjex.plans import q_dense as QD
    got = E.queries()["r1_pair_scorer"](spark, SF_SMALL)
    docs, labels = QD._inputs(spark, SF_SMALL)
    texts = docs.select("text").unionByName(labels.select(F.col("label_text").alias("text")))
    encoder = LsaEncoder.fit(texts, "text", dim=64)
    name, text = ({r[0]: r[1] for r in t.collect()} for t in (labels.select("gnd_id", "label_text"), docs.select("doc_id", "text")))
    best = QD.suggest_dense(docs, "doc_id", "text", "embedding", labels, topk=QD.TOPK)
    want = {}
    for r in best.where("doc_id % 10 = 0").collect():
        score = _plain(encoder, text[r["doc_id"]], name[r["gnd_id"]]) if r["rank"] <= QD.RERANK else r["score"]
        want.setdefault(r["doc_id"], {})[r["gnd_id"]] = round(score, 5)
    have = {}
    for r in got.where("doc_id % 10 = 0").orderBy("rank").collect():
        have.setdefault(r["doc_id"], {})[r["gnd_id"]] = r["score"]
    assert have.keys() == want.keys() and all(have[d].keys() == want[d].keys() for d in want)
    assert all(abs(have[d][g] - want[d][g]) < 1e-4 for d in want for g in want[d])
    assert all(list(s.values()) == sorted(s.values(), reverse=True) for s in have.values())


def test_plugged_encoder(spark):
    import __spark_entry__ as E
    from subjex.plans.q_io import _GramEncoder
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in E.queries()["e1_plugged_encoder"](spark, SF_SMALL).collect():
        v = _GramEncoder()([docs[r["doc_id"]]])[0]
        assert np.allclose(r["embedding"], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)


def test_a_record_is_split_into_terms_once(spark):
    """All candidates of a record are scored together, as pair by pair."""
    r = np.random.default_rng(1)
    encoder = LsaEncoder(r.random(128), r.standard_normal((128, 5)), r.random(5))
    scorer = LateInteraction(encoder)
    rows = [("a1 b2 c3", ["a1 d4", "e5", None, "", "a1 b2"]), (None, ["a1"]), ("", ["a1", "b2"]), ("x", []), ("a1 a1 A1", ["a1", "c3 a1"])]
    df = spark.createDataFrame(rows, "r string, t array<string>")
    for x in df.withColumn("s", scorer.many(F.col("r"), F.col("t"))).collect():
        assert np.allclose(x["s"], [_plain(encoder, x["r"], t) for t in x["t"]], atol=1e-12)
    split = []
    scorer.terms = lambda text, own=scorer.terms: split.append(text) or own(text)
    record, labels = scorer.terms("a1 b2 c3"), [scorer.terms(t) for t in ("a1", "b2 d4")]
    assert np.allclose(scorer.of_record(record, labels), [scorer.score(record, t) for t in labels]) and len(split) == 3
