"""Latent semantic vectors against numpy's singular value decomposition."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from subjex.operators import encoders as E
from subjex.operators.encoders import LsaEncoder, TfIdfEncoder


def _bucket(token, n):
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % n


def _matrix(texts, n):
    """Sublinear TF-IDF rows, normalised, and the idf."""
    count = np.zeros((len(texts), n))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            count[i, _bucket(w, n)] += 1
    idf = np.log((len(texts) + 1) / ((count > 0).sum(axis=0) + 1))
    x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), idf


def _texts():
    r = np.random.default_rng(0)
    topics = [[f"w{t}_{i}" for i in range(15)] for t in range(6)]
    return [" ".join(r.choice(topics[i % 6], 12)) + (f" Ü{i % 4}" if i % 3 else "") for i in range(90)] + [None, "", "  ", "Nowhere"]


def test_subspace_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK_ROWS", 50)
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    enc = LsaEncoder.fit(df, "t", dim=6, buckets=200, power=4)
    x, idf = _matrix(texts, 200)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(enc.idf, idf)
    assert np.allclose(enc.singular, s[:6], rtol=1e-6)
    # the same subspace: all cosines of principal angles are one
    assert np.allclose(np.linalg.svd(enc.projection.T @ vt[:6].T, compute_uv=False), 1, atol=1e-6)
    got = {r["id"]: np.array(r["v"]) for r in enc.transform(df, "t", "v").collect()}
    want = x @ enc.projection
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert all(np.allclose(got[i], want[i], atol=1e-5) for i in range(len(texts)))
    assert not got[90].any() and not got[91].any()


def test_stored_encoder_gives_the_same_vectors(spark, tmp_dir):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string")
    enc = LsaEncoder.fit(df, "t", dim=4, buckets=64)
    enc.save(spark, tmp_dir + "/lsa")
    again = LsaEncoder.load(spark, tmp_dir + "/lsa")
    one = spark.createDataFrame([("w1_1 w2_2 ü1",)], "t string")
    assert enc.transform(one, "t").first()["embedding"] == again.transform(one, "t").first()["embedding"]


def test_tfidf_vectors(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    enc = TfIdfEncoder.fit(df, "t", 50)
    n = len(texts)
    seen = [{_bucket(w, 50) for w in (t or "").lower().split()} for t in texts]
    for r in enc.transform(df, "t").collect():
        v = np.zeros(50)
        for w in (r["t"] or "").lower().split():
            b = _bucket(w, 50)
            v[b] += math.log((n + 1) / (sum(b in s for s in seen) + 1))
        v /= max(np.linalg.norm(v), 1e-12)
        assert np.allclose(r["embedding"], v)
    assert enc.transform(df.limit(0), "t").withColumn("x", F.lit(1)).count() == 0


def test_work_space_does_not_grow_with_the_batch():
    import tracemalloc

    import pyarrow as pa
    r = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array(list(r.integers(0, 8192, (2000, 300)).astype(np.int32)))], ["b"])
    idf, q = r.random(8192), r.standard_normal((8192, 74))
    tracemalloc.start()
    (part,) = E._gram_part(idf, q, False)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6, peak  # one slab; the whole batch would be 2000 * 300 * 74 numbers, 355 MB, twice
    row, b, value = E._sparse(batch.column(0), idf, 2000)
    x = np.zeros((2000, 8192))
    x[row, b] = value
    got = np.concatenate([np.frombuffer(m.as_py()).reshape(-1, 74) for m in part.column(1)])
    assert np.allclose(got, x.T @ (x @ q))


def test_vectors_of_a_batch_are_not_held_together():
    """Peak of a task's vectors for a batch of short texts, against a batch eight times as long."""
    import tracemalloc

    import pyarrow as pa
    r = np.random.default_rng(5)
    idf = r.random(240)
    peaks = []
    for rows in (2500, 20000):
        column = pa.array(list(r.integers(0, 240, (rows, 30)).astype(np.int32)))
        want = np.zeros((rows, 240))
        flat = column.flatten().to_numpy()
        np.add.at(want, (np.repeat(np.arange(rows), 30), flat), idf[flat])
        want /= np.linalg.norm(want, axis=1, keepdims=True)
        tracemalloc.start()
        at = 0
        for part in E._tfidf(idf)(iter([column.slice(0, 7), column.slice(7)])):
            got = part.flatten().to_numpy().reshape(len(part), 240)
            assert np.allclose(got, want[at:at + len(part)])
            at += len(part)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert at == rows
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 20e6, peaks  # 20,000 vectors at once: 38 MB, and as much for their norms


def test_vectors_of_null_and_empty_lists_keep_their_rows(spark):
    lists = [None, [], [3], None, [1, 1, 2]] * 700
    df = spark.createDataFrame([(i, b) for i, b in enumerate(lists)], "id int, b array<int>").coalesce(1)
    enc = TfIdfEncoder(np.linspace(1, 2, 400))
    got = {r["id"]: r["v"] for r in df.withColumn("v", enc.vector(F.col("b"), spark)).collect()}
    for i, b in enumerate(lists):
        v = np.zeros(400)
        for x in b or []:
            v[x] += enc.idf[x]
        assert np.allclose(got[i], v / max(np.linalg.norm(v), 1e-12))


def test_slices_cover_all_rows():
    import pyarrow as pa
    lists = pa.array([[1] * n if n is not None else None for n in (0, 3, None, 9, 1, 1, 1, 0, 2, 5)])
    got = list(E.slices(lists, 4))
    assert [a for a, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1]] and sum(n for _, n in got) == 10
    assert all(n == 1 or sum(len(x or []) for x in lists.slice(a, n).to_pylist()) <= 4 for a, n in got)
    assert list(E.slices(pa.array([], pa.list_(pa.int32())), 4)) == []


def test_documents_are_hashed_once(spark):
    """Encoder and vectors follow from one written table of term buckets."""
    from subjex.plans import fixtures as fx
    from testdata_paths import SF_SMALL
    buckets = fx.record_buckets(spark, SF_SMALL)
    encoder = fx.text_encoder(spark, SF_SMALL, buckets)
    got = fx.record_vectors(spark, SF_SMALL, encoder, buckets)
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = encoder.transform(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang"), "text")
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
