"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets.

1. One pass over the texts gives per document: set size, 128-bit set fingerprint, MinHash
   bands, and an odd sketch (the MinHash samples folded into a parity bitmap; the XOR of
   two sketches counts the samples in which they differ).
2. Documents of equal sets form a class, known by a 64-bit hash of the set's fingerprint
   (two of N sets share one with a chance of N**2 / 2**65); one of its texts stands for it.
3. Members of a band bucket are held against its smallest member: as many pairs as rows.
   A pair whose sketches cannot reach the threshold (five standard deviations of the
   estimate) is left; the others are confirmed on full sets.  Links give components.
4. Buckets that still hold several components: pairs across components, sketch first, in
   buckets of up to ``SMALL`` members; in larger ones members outside the bucket's main
   component meet all members in blocks of ``BLOCK`` rows, where shared shingles are
   counted exactly through an inverted index.  A task emits one link per pair of
   components, so a bucket never emits all its pairs.  All links again give components.

No bucket is capped.  A pair at similarity 0.85 shares no bucket with probability 1e-8
(at 0.80: 3e-6).

Defined results: null or wordless text has an empty set, linked with nothing; rows with one
doc_id are one document whose texts are linked; rows with a null doc_id take part, and the
component is the smallest id that is not null; repeated rows share a result; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.llm import tokens as T
from subjex.llm.graph import components
from subjex.session import written

SHINGLE = 5
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SMALL, BLOCK = 32, 4096
BATCH_BYTES = 1 << 19
_U = np.uint64
_XOR = T.mix(np.arange(1, SAMPLES + 1, dtype=_U))
_MUL = T.mix(np.arange(1, SAMPLES + 1, dtype=_U) + _U(1 << 32)) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Distinct shingle hashes of each text, sorted: (hashes, their number before each text).

    Words are lower-cased in A-Z; a text of fewer words has one shingle, all its words.
    """
    starts, before = T.word_places(data, offsets)
    words = T.word_hashes(data, starts, lower=True)
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    runs = T.rolling(words, size)
    inside = doc[:len(runs)] == doc[size - 1:size - 1 + len(runs)]
    h, d = runs[inside], doc[:len(runs)][inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = [T.mix(T.rolling(words[before[i]:before[i + 1]], int(n[i])) + _U(n[i])) for i in short]
        h, d = np.r_[h, np.concatenate(whole)], np.r_[d, short]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[fresh], np.searchsorted(d[fresh], np.arange(len(n) + 1))


def _signatures(h: np.ndarray, before: np.ndarray):
    """(bands, sketches, fingerprints) of the non-empty sets of a batch."""
    at, n = before[:-1], len(before) - 1
    samples = np.empty((n, SAMPLES), _U)
    for i in range(SAMPLES):
        samples[:, i] = np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], at)
    bands = np.broadcast_to(T.mix(np.arange(BANDS, dtype=_U) + _U(7)), (n, BANDS))
    for r in range(ROWS):
        bands = T.pair(bands, samples[:, r::ROWS])
    bit = (T.pair(np.arange(SAMPLES, dtype=_U), samples) % _U(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(parity, (np.repeat(np.arange(n), SAMPLES), bit.ravel()), 1)
    sketch = np.packbits(parity & 1, axis=1).view(np.int64)
    prints = [np.add.reduceat(T.mix(h + _U(c)), at).view(np.int64) for c in (11, 13)]
    return bands.view(np.int64), sketch, prints


def _nested(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(matrix.ravel()))


def _sign(batches):
    for batch in batches:
        data, offsets = T.text_buffers(batch.column("text"))
        for i, j in T.slices(offsets, BATCH_BYTES):
            h, before = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            size = np.diff(before)
            full = np.flatnonzero(size)
            bands, sketch = np.zeros((j - i, BANDS), np.int64), np.zeros((j - i, SKETCH_BITS // 64), np.int64)
            prints = [np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)]
            if len(full):
                b, s, p = _signatures(h, np.r_[before[:-1][full], len(h)])
                bands[full], sketch[full] = b, s
                for k in (0, 1):
                    prints[k][full] = p[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(size.astype(np.int64)),
                 *map(pa.array, prints), _nested(bands), _nested(sketch)],
                ["doc_id", "th", "n_shingles", "print_a", "print_b", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, th: hash of the text, text): set size, fingerprint, bands, odd sketch."""
    return docs.mapInArrow(_sign, "doc_id long, th long, n_shingles long, print_a long, print_b long, "
                                  "bands array<long>, sketch array<long>")


def sketch_distance(a, b):
    """Bits in which two sketch columns differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def most_differing(percent: int) -> int:
    """The largest sketch distance of a pair that may still reach ``percent``: the expected
    distance at the similarity five standard deviations of the sample below it."""
    j = percent / 100
    low = max(0.0, j - 5 * math.sqrt(j * (1 - j) / SAMPLES))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - low)))
    return int(mean + 4 * math.sqrt(mean * (1 - mean / SKETCH_BITS)) / 2)


def _confirm(percent: int):
    """Keep the pairs (a, b, text_a, text_b) whose full sets reach ``percent``."""
    def run(batches):
        for batch in batches:
            kept = []
            sides = [T.text_buffers(batch.column(c)) for c in ("text_a", "text_b")]
            for i in range(batch.num_rows):
                a, b = (shingle_sets(d[o[i]:o[i + 1]], np.array([0, o[i + 1] - o[i]]))[0] for d, o in sides)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both) > 0:
                    kept.append(i)
            out = batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
            yield out
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on the full sets; ``texts``: rep, text."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def _across(percent: int):
    """One block of a large bucket: queries against all members, one link per pair of components."""
    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        _, first = np.unique(rep, return_index=True)
        query = np.isin(rep, rep[table.column("query").to_numpy(zero_copy_only=False)])[first]
        rep, comp = rep[first], table.column("comp").to_numpy()[first]
        data, offsets = T.text_buffers(table.column("text").take(pa.array(first)))
        h, before = shingle_sets(data, offsets)
        size = np.diff(before)
        _, ids = np.unique(h, return_inverse=True)
        owner = np.repeat(np.arange(len(rep)), size)
        order = np.argsort(ids, kind="stable")
        posting, start = owner[order], np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        a, b = [], []
        for q in np.flatnonzero(query):
            mine = ids[before[q]:before[q + 1]]
            shared = np.bincount(np.concatenate([posting[start[i]:start[i + 1]] for i in mine]), minlength=len(rep))
            linked = np.flatnonzero((100 * shared >= percent * (size[q] + size - shared)) & (shared > 0))
            for m in linked[np.unique(comp[linked], return_index=True)[1]]:
                x, y = find(int(comp[q])), find(int(comp[m]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(int(rep[q]))
                    b.append(int(rep[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _with_component(rows: DataFrame, comp: DataFrame, node: str = "rep") -> DataFrame:
    """Add ``comp``: the component of ``node``, itself without links."""
    comp = comp.select(F.col("node").alias("_node"), F.col("component"))
    return rows.join(comp, F.col(node) == F.col("_node"), "left") \
        .withColumn("comp", F.coalesce("component", node)).drop("_node", "component")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row per row of
    ``docs`` (doc_id, text); links need ``100 * intersection >= percent * union``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    signed = written(signatures(docs), "signatures")
    same_set = F.xxhash64("print_a", "print_b", "n_shingles").alias("rep")
    reps = written(signed.where("n_shingles > 0").groupBy(same_set).agg(
        F.min("th").alias("th"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "classes")
    band_rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = band_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    members = written(band_rows.join(shared, "key"), "buckets")
    sketches = reps.select("rep", "sketch")
    busy = members.select("rep").distinct()
    texts = written(docs.select("th", "text").join(reps.select("rep", "th").join(busy, "rep"), "th")
                    .dropDuplicates(["th"]).select("rep", "text"), "candidate-texts")
    limit = most_differing(percent)

    def likely(pairs):
        near = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a") \
            .join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        return near.where(sketch_distance(F.col("sa"), F.col("sb")) <= limit).select("a", "b")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(confirmed(likely(star), texts, percent), "star-links")
    comp = components(links)

    placed = _with_component(members.where("n > 2"), comp)
    per_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    open_buckets = per_comp.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("comp", "m").alias("main"),
                                               (F.sum("m") - F.max("m")).alias("outside")).where("parts > 1")
    placed = written(placed.join(open_buckets, "key"), "open-buckets")

    few = placed.where(F.col("n") <= SMALL)
    left, right = (few.select("key", F.col("rep").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    cross = left.join(right, "key").where("comp_a <> comp_b and a < b").select("a", "b").distinct()
    found = confirmed(likely(cross), texts, percent)

    many = placed.where(F.col("n") > SMALL).withColumn("query", F.col("comp") != F.col("main"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    many = many.withColumns({"qb": blocks("outside"), "mb": blocks("n")})
    own = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_member = many.select("key", "rep", "comp", F.lit(False).alias("query"), every("qb").alias("qb"), own("mb", 1).alias("mb"))
    as_query = many.where("query").select("key", "rep", "comp", "query", own("qb", 2).alias("qb"), every("mb").alias("mb"))
    grid = as_member.unionByName(as_query).groupBy("key", "qb", "mb", "rep", "comp").agg(F.max("query").alias("query"))
    blocks_found = grid.join(texts, "rep").groupBy("key", "qb", "mb").applyInArrow(_across(percent), "a long, b long")

    both = _with_component(_with_component(found.unionByName(blocks_found), comp, "a").withColumnRenamed("comp", "ca"), comp, "b")
    # the first components as edges to their smallest member, and the links between them
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(both.select("ca", F.col("comp")))
    # documents of several texts: each text's class joins the document's smallest one
    own = signed.where("n_shingles > 0").select("doc_id", same_set)
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last")
    edges = edges.union(own.join(several, "doc_id").select(F.col("rep").alias("a"), "b"))
    classes = _with_component(reps.select("rep", "least"), components(edges))
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = classes.select("rep", "comp").join(least, "comp").select("rep", "component_id")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, same_set).alias("rep"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(ids, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"),
                                                F.col("doc_id").eqNullSafe(component).alias("kept"))
