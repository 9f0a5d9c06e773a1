"""Jaccard join on word-shingle sets, filtered by prefixes under several global orders.

If two sets reach the threshold, then under *any* total order of the tokens the first
``n - ceil(t * n) + 1`` tokens of each (n its size) have one in common.  So a pair must share
a prefix token under every one of ``ORDERS`` orders; the filters are intersected, and what is
left is confirmed on the full sets.

The orders put rare tokens first.  Each hashes the tokens into ``BINS`` counters of its own,
filled from all documents; a token's rank is its counter, then its hash.  A frequent token is
late in every order; a middling one that lands in a light counter under one order rarely does
so under the next, which is what the intersection removes.  Counters are estimates, but any
order gives an exact join.

1. One pass counts the tokens per order and bin; the counters are of fixed size.
2. A second pass gives each document its set size, a fingerprint of the set and the prefix
   under the first order.  Documents of equal sets are one node from here on.
3. Nodes that share a first-order prefix token with another node are put in a Bloom filter of
   fixed size (by the hash of one text), and a third pass makes the other prefixes of these
   only.  The same test under the second order drops more nodes; the texts of those that are
   left are fetched in the same way.
4. Nodes that share a first-order token form a bucket.  Every member meets the bucket's
   smallest node: as many pairs as rows.  Pairs that fit in size, may have enough common
   first-order tokens and overlap in every other prefix are confirmed; links give components.
5. Buckets that still hold several components: members outside the bucket's main component
   meet all members, pair by pair in buckets of up to ``SMALL`` members, else in blocks of
   ``BLOCK`` rows, where shared tokens are counted through an inverted index and one link per
   pair of components leaves the task.

No bucket is capped and no group's pairs are all emitted.  Tokens are 64-bit hashes of
shingles and a set's node is a 64-bit fingerprint: two of N different sets are taken for one
with a chance of N**2 / 2**64.

Defined results: a null or wordless text has an empty set, linked with nothing (its
component is its own id); rows with one doc_id are one document whose texts are linked; rows
with a null doc_id take part, and the component is the smallest id that is not null; repeated
rows share a result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm import tokens as T
from subjex.llm.graph import components
from subjex.llm.near_dup import shingle_sets
from subjex.session import ship_package, written

SHINGLE = 4
ORDERS = 3
BINS = 1 << 18
#: Counters handed on per row.
PACK = 16
#: Bits of the Bloom filter of nodes, in words of 64; two bits a node.
BLOOM_WORDS = 1 << 19
SMALL, BLOCK = 32, 4096
BATCH_BYTES = 1 << 19
_U = np.uint64


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of size ``n`` that must hold one of any partner's prefix."""
    return n - -(-percent * n // 100) + 1


def order_hashes(h: np.ndarray, order: int) -> np.ndarray:
    """The tokens' hashes under one order."""
    return T.mix(h ^ T.mix(np.full(1, order + 101, _U)))


def bins_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each order hash, from its high bits; ``bins`` is a power of two."""
    return (hashes >> _U(64 - (bins - 1).bit_length())).astype(np.int64)


def _sets_of(column):
    """Slices of a text column: (from, to, distinct shingle hashes, places before each text)."""
    data, offsets = T.text_buffers(column)
    for i, j in T.slices(offsets, BATCH_BYTES):
        yield i, j, *shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], SHINGLE)


def _count(bins: int):
    def run(batches):
        counts = np.zeros((ORDERS, bins), np.int64)
        for batch in batches:
            for _, _, h, _ in _sets_of(batch.column("text")):
                for m in range(ORDERS):
                    counts[m] += np.bincount(bins_of(order_hashes(h, m), bins), minlength=bins)
        rows = counts.reshape(-1, PACK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(rows[used, c]) for c in range(PACK)],
                                         ["slot"] + [f"c{c}" for c in range(PACK)])
    return run


def token_counters(docs: DataFrame, bins: int = BINS) -> np.ndarray:
    """Tokens of all documents (column text) per order and bin; of fixed size."""
    columns = [f"c{c}" for c in range(PACK)]
    parts = docs.select("text").mapInArrow(_count(bins), "slot long, " + ", ".join(f"{c} long" for c in columns))
    rows = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((ORDERS * bins // PACK, PACK), np.int64)
    out[rows.column("slot").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
    return out.reshape(ORDERS, bins)


def prefixes(h: np.ndarray, before: np.ndarray, order: int, counter: np.ndarray, percent: int):
    """Each set's prefix under one order: (tokens, their number before each set)."""
    own = order_hashes(h, order)
    size = np.diff(before)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.lexsort((own, counter[bins_of(own, len(counter))], doc))
    length = np.where(size > 0, prefix_length(size, percent), 0)
    keep = np.arange(len(h)) - np.repeat(before[:-1], size) < np.repeat(length, size)
    return own[place][keep].view(np.int64), np.r_[0, np.cumsum(length)]


def node_of(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; 0 for the empty one."""
    out = np.zeros(len(before) - 1, _U)
    full = np.flatnonzero(np.diff(before))
    if len(full):
        at = before[:-1][full]
        both = T.pair(np.add.reduceat(T.mix(h + _U(21)), at), np.add.reduceat(T.mix(h + _U(23)), at))
        out[full] = T.pair(both, np.diff(before)[full].astype(_U)) | _U(1)
    return out.view(np.int64)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _first_prefixes(counter: np.ndarray, percent: int):
    def run(batches):
        for batch in batches:
            for i, j, h, before in _sets_of(batch.column("text")):
                tokens, ends = prefixes(h, before, 0, counter, percent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(np.diff(before)),
                     pa.array(node_of(h, before)), _lists(ends, tokens)], ["doc_id", "th", "n_shingles", "node", "prefix"])
    return run


def _bloom_bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of each key in the Bloom filter."""
    x = T.mix(key.view(_U) + _U(31))
    return (x >> _U(40)).astype(np.int64) % BLOOM_WORDS, (_U(1) << (x & _U(63))) | (_U(1) << ((x >> _U(6)) & _U(63)))


def _bloom(batches):
    for batch in batches:
        word, bits = _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """Bit words of a Bloom filter over ``keys`` (one long column); of fixed size."""
    rows = keys.mapInArrow(_bloom, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BLOOM_WORDS, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def _likely(bloom: np.ndarray, key: str):
    """Rows whose ``key`` may be in the Bloom filter."""
    def run(batches):
        for batch in batches:
            word, bits = _bloom_bits(batch.column(key).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(bloom[word] & bits == bits))
    return run


def likely_rows(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys`` (one long column), so
    that an exact join moves fewer."""
    return rows.mapInArrow(_likely(bloom_filter(keys), key), rows.schema)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of each of ``nodes`` (node, th: one each); ``docs``: th, text."""
    likely = likely_rows(docs.select("th", "text"), "th", nodes.select("th"))
    return likely.join(nodes.select("node", "th"), "th").dropDuplicates(["th"]).select("node", "text")


def _further_prefixes(counters: np.ndarray, percent: int, bloom: np.ndarray):
    """(th, node, n, p1, ...) of the rows whose text hash may be in the Bloom filter."""
    likely = _likely(bloom, "th")

    def run(batches):
        for batch in likely(batches):
            for i, j, h, before in _sets_of(batch.column("text")):
                further = []
                for m in range(1, ORDERS):
                    tokens, ends = prefixes(h, before, m, counters[m - 1], percent)
                    further.append(_lists(ends, tokens))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("th").slice(i, j - i), pa.array(np.diff(before)), *further],
                    ["th", "n", *[f"p{m}" for m in range(1, ORDERS)]])
    return run


def _shared(rows: DataFrame) -> DataFrame:
    """(token, node) rows -> tokens that several nodes hold, with their smallest node."""
    return rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")


def _confirm(percent: int):
    """Keep the pairs (a, b, text_a, text_b) whose full sets reach ``percent``."""
    def run(batches):
        for batch in batches:
            kept = []
            sides = [T.text_buffers(batch.column(c)) for c in ("text_a", "text_b")]
            for i in range(batch.num_rows):
                a, b = (shingle_sets(d[o[i]:o[i + 1]], np.array([0, o[i + 1] - o[i]]), SHINGLE)[0] for d, o in sides)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both) > 0:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, c) that pass all filters and hold on the full sets.

    ``c``: common first-order prefix tokens, at most.  Of tokens behind the earlier end of the
    two prefixes at most ``ceil(t * n) - 1`` are common (n the larger size), so ``c`` must make
    up for the rest of the overlap that the sizes ask for.  Then every further order's prefixes
    must overlap.  ``nodes``: node, n, p1, ...; ``texts``: node, text, joined last.
    """
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    up = lambda x, y: F.floor((x + F.lit(y - 1)) / F.lit(y))
    overlap = up(percent * (F.col("na") + F.col("nb")), 100 + percent)
    fits = (100 * small >= percent * large) & (F.col("c") >= overlap - up(percent * large, 100) + 1)
    pairs = written(pairs.where(fits).select("a", "b"), "sized-pairs")
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node"))
    nodes = likely_rows(nodes, "node", ends(pairs))
    extra = [f"p{m}" for m in range(1, ORDERS)]
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(p).alias(f"{p}{side}") for p in extra]), side)
    for p in extra:
        pairs = pairs.where(F.arrays_overlap(f"{p}a", f"{p}b"))
    both = written(pairs.select("a", "b"), "candidate-pairs")
    texts = likely_rows(texts, "node", ends(both))
    for side in "ab":
        both = both.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")


def _block_links(percent: int):
    """One block of a bucket: queries against all members, one link per pair of components."""
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        asks = np.isin(node, node[table.column("asks").to_numpy(zero_copy_only=False)])[first]
        node, comp = node[first], table.column("comp").to_numpy()[first]
        data, offsets = T.text_buffers(table.column("text").take(pa.array(first)))
        h, before = shingle_sets(data, offsets, SHINGLE)
        size = np.diff(before)
        _, ids = np.unique(h, return_inverse=True)
        owner = np.repeat(np.arange(len(node)), size)
        by_token = np.argsort(ids, kind="stable")
        holder, start = owner[by_token], np.r_[0, np.cumsum(np.bincount(ids))]
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c
        links = []
        for q in np.flatnonzero(asks):
            mine = ids[before[q]:before[q + 1]]
            shared = np.bincount(np.concatenate([holder[start[t]:start[t + 1]] for t in mine]), minlength=len(node))
            near = np.flatnonzero((100 * shared >= percent * (size[q] + size - shared)) & (shared > 0))
            for m in near[np.unique(comp[near], return_index=True)[1]]:
                x, y = find(int(comp[q])), find(int(comp[m]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(node[q]), int(node[m])))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _placed(rows: DataFrame, comp: DataFrame, node: str) -> DataFrame:
    """Add ``comp``: the component of ``node``, itself without links."""
    comp = comp.select(F.col("node").alias("_own"), F.col("component").alias("_found"))
    return rows.join(comp, F.col(node) == F.col("_own"), "left") \
        .withColumn("comp", F.coalesce("_found", node)).drop("_own", "_found")


def _cross_links(members: DataFrame, comp: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between different components within the buckets ``members`` (token, node)."""
    placed = written(_placed(members, comp, "node"), "placed-members")
    parts = placed.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.sum("m").alias("n"), F.count("*").alias("parts"), F.max_by("comp", F.struct("m", "comp")).alias("main"),
        (F.sum("m") - F.max("m")).alias("outside")).where("parts > 1 and n > 2")
    placed = written(placed.join(parts, "token"), "open-buckets")
    few = placed.where(F.col("n") <= SMALL)
    left, right = (few.select("token", F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    cross = left.join(right, "token").where("comp_a <> comp_b and a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    # common tokens of large buckets are not counted above: at most as many as either node has
    large = placed.where(F.col("n") > SMALL).groupBy("node").agg(F.count("*").alias("k"))
    for side in "ab":
        cross = cross.join(large.select(F.col("node").alias(side), F.col("k").alias(f"k{side}")), side, "left")
    more = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    found = _confirmed(cross.select("a", "b", (F.col("c") + more).alias("c")), nodes, texts, percent)

    many = placed.where(F.col("n") > SMALL).withColumn("asks", F.col("comp") != F.col("main"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    many = many.withColumns({"qb": blocks("outside"), "mb": blocks("n")})
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_member = many.select("token", "node", "comp", F.lit(False).alias("asks"), every("qb").alias("qb"), own("mb", 1).alias("mb"))
    as_query = many.where("asks").select("token", "node", "comp", "asks", own("qb", 2).alias("qb"), every("mb").alias("mb"))
    grid = as_member.unionByName(as_query).groupBy("token", "qb", "mb", "node", "comp").agg(F.max("asks").alias("asks"))
    in_blocks = grid.join(texts, "node").groupBy("token", "qb", "mb").applyInArrow(_block_links(percent), "a long, b long")
    return found.unionByName(in_blocks)


def jaccard_join(docs: DataFrame, percent: int = 85, bins: int = BINS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per row of
    ``docs`` (doc_id, text); documents link when ``100 * intersection >= percent * union``."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    counters = token_counters(docs, bins)
    sets = written(docs.mapInArrow(_first_prefixes(counters[0], percent),
                                   "doc_id long, th long, n_shingles long, node long, prefix array<long>"), "prefixes")
    tokens = sets.where("n_shingles > 0").select("node", F.explode("prefix").alias("token"))
    members = written(tokens.join(_shared(tokens).select("token"), "token", "left_semi").distinct(), "members")
    # one text stands for the texts of a node
    active = written(sets.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")),
                     "active-nodes")

    schema = "th long, n long, " + ", ".join(f"p{m} array<long>" for m in range(1, ORDERS))
    likely = docs.select("th", "text").mapInArrow(_further_prefixes(counters[1:], percent, bloom_filter(active.select("th"))), schema)
    nodes = written(likely.join(active, "th").dropDuplicates(["th"]), "further-prefixes")
    # the second order drops more nodes before texts are fetched; all orders are asked of pairs
    own = nodes.select("node", F.explode("p1").alias("token"))
    left = written(own.join(_shared(own), "token", "left_semi").select("node").distinct(), "active-nodes")
    texts = written(texts_of(docs, active.join(left, "node", "left_semi")), "candidate-texts")
    members = members.join(left, "node", "left_semi")
    members = written(members.join(_shared(members).select("token", "leader"), "token"), "buckets")

    # a star pair has at most as many common tokens as either node has shared ones
    held = members.groupBy("node").agg(F.count("*").alias("k"))
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        star = star.join(held.select(F.col("node").alias(side), F.col("k").alias(f"k{side}")), side)
    links = written(_confirmed(star.select("a", "b", F.least("ka", "kb").alias("c")), nodes, texts, percent), "star-links")
    comp = components(links)
    more = _cross_links(members.select("token", "node"), comp, nodes, texts, percent)

    # documents of several texts join their nodes; each text's node joins its document's least one
    several = sets.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(
        F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last")
    same_id = sets.where("n_shingles > 0").join(several.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")
    edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")).union(same_id)
    final = components(edges)
    per_node = _placed(sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")), final, "node")
    least = per_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = per_node.select("node", "comp").join(least, "comp").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(ids, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
