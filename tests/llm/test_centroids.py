import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjex.llm import centroids as C


def brute(rows, dim, n_centers, rounds, scale):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(scale * x) for x in v]))
    digest = lambda k: hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest()
    centers = [v for _, v in sorted(((digest(k), v) for k, v in kept))[:n_centers]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        centers = [[sum(col) // near.count(i) for col in zip(*[v for (_, v), a in zip(kept, near) if a == i])]
                   if i in near else c for i, c in enumerate(centers)]
    last = [(k, *nearest(v)) for k, v in kept]
    per = {i: sum(d for _, d, j in last if j == i) for i in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(k), i, d, per[i], sum(per.values()), sha[i]) for k, d, i in last)


def rows_of(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in df.collect())


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    vecs = r.normal(0, .4, (240, 8)).astype(np.float32).round(2).tolist()  # coarse values: many ties
    rows = [(i, v) for i, v in enumerate(vecs)]
    rows += [(3, vecs[3]), (3, vecs[9]), (None, vecs[5]), (900, None), (901, []), (902, vecs[0][:7]), (903, vecs[0] + [1.0]),
             (904, [None] + vecs[0][1:]), (905, [float("nan")] * 8), (906, [float("inf")] + vecs[1][1:]),
             (907, [-1e5] * 8), (908, [0.0] * 8), (909, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, emb array<float>").repartition(5)
    df = df.withColumns({c: F.lit(c) for c in ("key", "v", "cluster", "distance", "inertia", "h", "pos")})
    got = rows_of(C.cluster(df, "vec_id", "emb", 8, 12, 3, 256))
    assert got == brute(rows, 8, 12, 3, 256)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, emb array<float>")
    assert rows_of(C.cluster(df, "vec_id", "emb", 2, 40, 2)) == brute(rows, 2, 40, 2, 256)
    assert C.cluster(df.limit(0), "vec_id", "emb", 2).count() == 0
    assert C.cluster(df, "vec_id", "emb", 64).count() == 0


def test_component_beyond_the_exact_range_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, emb array<float>")
    with pytest.raises(Exception, match="not below"):
        C.cluster(df, "vec_id", "emb", 2)


@pytest.mark.parametrize("size", [1, 100, C.LIMIT - 1])
def test_search_is_exact_and_rejects(size):
    """Equal to full measuring, at component sizes up to the limit; most centroids are rejected
    where sums spread."""
    r = np.random.default_rng(7)
    base = r.integers(-size, size + 1, (2000, 1))
    x = np.clip(base + r.integers(-max(1, size // 20), max(1, size // 20) + 1, (2000, 64)), -size, size).astype(np.int64)
    centers = np.concatenate([x[:39], x[5:6]])
    counts = {}
    number, best = C.Search(centers).nearest(x, counts)
    full = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, full.min(axis=1)) and np.array_equal(number, full.argmin(axis=1))
    assert sum(counts.values()) == 2000 * 40
    if size > 1:
        assert counts["measured"] < 2000 * 40 / 5
