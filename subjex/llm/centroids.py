"""Exact nearest centroids by equal-average equal-variance search, and rounds of clustering.

Vectors are integers.  For a vector x of k components with sum S(x) and deviation
v(x) = ||x - mean(x)||, every centroid c satisfies

    k * |x - c|^2  >=  (S(x) - S(c))^2 + k * (v(x) - v(c))^2.

Centroids are sorted by sum.  A vector starts at the centroid next to its own sum and looks
outward on both sides: a side ends for good once the first term alone exceeds the best
distance found, a centroid is passed over when both terms do, and only the others are
measured, in 64-bit integers.  The sums are exact; the deviations are square roots, so their
difference is shrunk by a bound on its rounding error before it may reject.  Ties go to the
smaller centroid number, since only strictly larger bounds reject.

Each round is one pass over the written vectors; tasks hand on sums and counts per centroid
(centroids x components numbers a task), which Spark adds up.

Defined results: vectors of another length, null, or with a null or non-finite component are
left out; repeated rows are separate vectors; a null id hashes as the empty string; with
fewer vectors than centroids all are starting centroids; an empty table gives no rows; other
columns are ignored.  A component of ``LIMIT`` or more after scaling would not leave the
squared distance in 64 bits and is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.session import ship_package, written

#: Components are below this, so that 64 squared differences stay below 2**63.
LIMIT = 1 << 27
#: Vectors compared at a time.
SLAB = 8192
#: Relative rounding error allowed to a computed deviation.
SLACK = 1e-12


class Search:
    """Centroids (number x component, int64) prepared for the outward scan."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        total = centers.sum(axis=1)
        self.order = np.argsort(total, kind="stable")
        self.sorted = centers[self.order]
        self.total = total[self.order]
        self.dev = deviations(self.sorted, self.total)

    def nearest(self, x: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroid number, squared distance) of each row of ``x``; ``counts`` collects the
        centroids measured and those rejected by either inequality."""
        n, k = x.shape
        m = len(self.total)
        total = x.sum(axis=1)
        dev = deviations(x, total)
        at = np.minimum(np.searchsorted(self.total, total), m - 1)
        best = _squared(x, self.sorted[at])
        number = self.order[at]
        measured, by_mean, by_dev = n, 0, 0
        for step in (-1, 1):
            rows = np.arange(n)
            place = at + step
            while True:
                inside = (place >= 0) & (place < m)
                rows, place = rows[inside], place[inside]
                if not len(rows):
                    break
                gap = (total[rows] - self.total[place]).astype(np.float64) ** 2 / k
                open_side = gap * (1 - SLACK) <= best[rows]
                left = np.where(open_side, 0, m - place if step > 0 else place + 1)
                by_mean += int(left.sum())
                rows, place, gap = rows[open_side], place[open_side], gap[open_side]
                own, other = dev[rows], self.dev[place]
                apart = np.maximum(np.abs(own - other) - SLACK * (own + other), 0.0)
                likely = (gap + apart * apart) * (1 - SLACK) <= best[rows]
                by_dev += int((~likely).sum())
                r, p = rows[likely], place[likely]
                measured += len(r)
                d = _squared(x[r], self.sorted[p])
                number_p = self.order[p]
                better = (d < best[r]) | ((d == best[r]) & (number_p < number[r]))
                best[r[better]], number[r[better]] = d[better], number_p[better]
                place = place + step
        if counts is not None:
            for name, value in (("measured", measured), ("mean", by_mean), ("deviation", by_dev)):
                counts[name] = counts.get(name, 0) + value
        return number, best


def deviations(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """||x - mean(x)|| of integer rows, from centred values (no cancellation of large sums)."""
    centred = x - (total / x.shape[1])[:, None]
    return np.sqrt((centred * centred).sum(axis=1))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def integer_vectors(vectors: DataFrame, key: str, vec: str, dim: int, scale: int) -> DataFrame:
    """(key, v array<long>) of the vectors with exactly ``dim`` finite components, each
    turned into ``floor(scale * component)``."""
    real = F.transform(F.col(vec), lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.size(vec) == dim) & F.coalesce(finite, F.lit(False)))
    scaled = F.transform(real, lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall(scaled, lambda x: F.abs(x) < F.lit(LIMIT))
    return kept.select(F.col(key).alias("key"), F.when(fits, scaled).otherwise(
        F.raise_error(F.lit(f"a scaled component is not below {LIMIT}"))).alias("v"))


def start_centers(vectors: DataFrame, n: int, seed: str) -> np.ndarray:
    """The ``n`` vectors (at most) with the smallest sha256 of ``seed:key``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(n).collect()  # bounded: n vectors
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _sums(centers: np.ndarray):
    def run(batches):
        search = Search(centers)
        total, count = np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, centers.shape[1]), np.int64)
            for i in range(0, len(x), SLAB):
                part = x[i:i + SLAB]
                near, _ = search.nearest(part)
                order = np.argsort(near, kind="stable")
                own, first = np.unique(near[order], return_index=True)
                total[own] += np.add.reduceat(part[order], first, axis=0)
                count += np.bincount(near, minlength=len(centers))
        used = np.flatnonzero(count)
        width = centers.shape[1]
        offsets = np.arange(len(used) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[used].ravel()))], ["cluster", "n", "s"])
    return run


def next_centers(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """One round: every centroid with vectors becomes their componentwise floor(sum / count)."""
    parts = vectors.select("v").mapInArrow(_sums(centers), "cluster int, n long, s array<long>")
    wide = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")) \
        .groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centers.copy()
    for r in wide.collect():  # bounded: centroids x components
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def _assign(centers: np.ndarray):
    def run(batches):
        search = Search(centers)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            parts = [search.nearest(x[i:i + SLAB]) for i in range(0, len(x), SLAB)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.concatenate([p[0] for p in parts]).astype(np.int32)),
                 pa.array(np.concatenate([p[1] for p in parts]))], ["key", "cluster", "distance"])
    return run


def assign(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(key, cluster int, distance long) of every vector (key, v)."""
    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "v").mapInArrow(_assign(centers), f"key {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, key: str, vec: str, dim: int = 64, n_centers: int = 40, rounds: int = 5,
            scale: int = 256, seed: str = "2") -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    ship_package(vectors.sparkSession)
    ints = written(integer_vectors(vectors, key, vec, dim, scale), "integer-vectors")
    centers = start_centers(ints, n_centers, seed)
    if not len(centers):
        centers = np.zeros((1, dim), np.int64)  # an empty table: no vector will meet it
    for _ in range(rounds):
        centers = next_centers(ints, centers)
    placed = written(assign(ints, centers), "assigned-vectors")
    spark = vectors.sparkSession
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centers)],
        "cluster int, centroid_sha256 string")
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    whole = per.withColumn("whole", F.lit(per.agg(F.sum("part")).first()[0]))
    known = whole.join(digests, "cluster").select(
        "cluster", F.col("part").cast("long").alias("cluster_inertia"), F.col("whole").cast("long").alias("inertia"),
        "centroid_sha256")
    # at most one row a centroid
    return placed.join(F.broadcast(known), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
