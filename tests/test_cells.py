"""Cell trees and residual codes: exact with every cell, recall and scored share on real vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjex.operators import cells as C
from subjex.operators.encoders import LsaEncoder
from subjex.operators.neighbors import exact_top_k
from subjex.plans import fixtures as fx
from subjex.session import written
from subjex.sources.tables import table
from testdata_paths import SF_MID

SF_LARGE = "/root/testdata/sf0.1"


def _ranked(df, q, i):
    return {(r[q], r["rank"]): (r[i], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("branches, item_block, query_block", [((4,), 8192, 16384), ((3, 5), 40, 60), ((2, 3, 4), 7, 1000)])
def test_all_cells_equal_exact_search(spark, branches, item_block, query_block):
    """Also with blocks that hold several cells and cells that need several blocks."""
    queries, items = fx.stored_vectors(spark, SF_MID)
    exact = _ranked(exact_top_k(queries, "vec_id", "embedding", items, "neighbor_id", "embedding", 7), "vec_id", "neighbor_id")
    index = C.build_cells(items, "neighbor_id", "embedding", branches)
    assert index.tree.n_cells == np.prod(branches) and index.counts.sum() == items.count()
    found = C.search(queries, "vec_id", "embedding", index, 7, index.tree.n_cells, beam=10**6,
                     item_block=item_block, query_block=query_block)
    assert _ranked(found, "vec_id", "neighbor_id") == exact


def test_block_plan_covers_every_item():
    r = np.random.default_rng(1)
    for _ in range(50):
        counts = r.integers(0, 30, 40)
        first, blocks = C.block_plan(counts, 12)
        load = {}
        for c, n in enumerate(counts):
            for b in range(first[c], first[c] + blocks[c]):
                load.setdefault(b, []).append(c)
        for own in load.values():
            assert len(own) == 1 or sum(counts[c] for c in own) <= 12
        assert all(blocks[c] == max(1, -(-counts[c] // 12)) for c in range(40))


def test_beam_with_every_node_is_the_exact_order():
    r = np.random.default_rng(2)
    low = r.normal(size=(24, 8))
    tree = C.CellTree([low[:4], low])
    x = r.normal(size=(50, 8))
    far = ((x[:, None] - low[None]) ** 2).sum(axis=2)
    assert np.array_equal(tree.nearest(x, 24, beam=24), np.argsort(far, axis=1))


def test_table_sums_equal_decoded_products():
    """Scores read from tables are the products with the quantised vectors, undecoded."""
    r = np.random.default_rng(3)
    tree = C.CellTree([r.normal(size=(5, 12))])
    book = C.PqCodebook(r.normal(size=(4, 16, 3)), 4, 3)
    cell = np.sort(r.integers(0, 5, 60))
    codes = r.integers(0, 16, (60, 4)).astype(np.uint8)
    q = r.normal(size=(9, 12))
    got = C.block_scores(q, np.ones((9, len(np.unique(cell))), bool), cell, None, codes, tree, book)
    decoded = tree.centers[cell] + np.hstack([book.codebooks[j][codes[:, j]] for j in range(4)])
    assert np.allclose(got, decoded @ q.T, atol=1e-5)


def test_residual_codes_search(spark):
    """Codes alone find most neighbours, refined ones nearly all; every row is indexed."""
    queries, items = fx.stored_vectors(spark, SF_LARGE)
    some = queries.where(F.col("vec_id") % 50 == 0)
    index = C.build_cells(items, "neighbor_id", "embedding", (16, 16), m=16)
    assert index.items.count() == items.count()
    assert index.items.where(F.octet_length("codes") != 16).count() == 0
    want = set(_pairs(exact_top_k(some, "vec_id", "embedding", items, "neighbor_id", "embedding", 11)))
    plain = set(_pairs(C.search(some, "vec_id", "embedding", index, 11, 256, beam=256)))
    fine = set(_pairs(C.search(some, "vec_id", "embedding", index, 11, 256, refine=44, beam=256)))
    print("recall of codes", len(want & plain) / len(want), "refined", len(want & fine) / len(want))
    assert len(want & plain) >= 0.6 * len(want) and len(want & fine) >= 0.95 * len(want)


def _pairs(df):
    return [(r["vec_id"], r["neighbor_id"]) for r in df.collect() if r["vec_id"] != r["neighbor_id"]]


def test_text_vectors_need_a_tenth_of_the_pairs(spark):
    """Latent semantic vectors of all documents of sf0.1 in 256 cells: recall of at least 0.9
    with at most a tenth of the pairs scored, over the rows with id divisible by 50."""
    docs = table(spark, SF_LARGE, "documents").where("text is not null").repartition(8)
    encoder = LsaEncoder.fit(docs, "text", 32)
    vectors = written(encoder.transform(docs, "text").select("doc_id", "embedding").where(F.exists("embedding", lambda x: x != 0)), "v")
    items = vectors.withColumnRenamed("doc_id", "neighbor_id")
    queries = vectors.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "vec_id")
    index = C.build_cells(items, "neighbor_id", "embedding", (16, 16), m=16)
    want = set(_pairs(exact_top_k(queries, "vec_id", "embedding", items, "neighbor_id", "embedding", 11)))
    share = C.scored_share(queries, "embedding", index, 8)
    exact = set(_pairs(C.search(queries, "vec_id", "embedding", C.CellIndex(index.items, index.tree, "neighbor_id", "embedding"), 11, 8)))
    coded = set(_pairs(C.search(queries, "vec_id", "embedding", index, 11, 8, refine=44)))
    print("scored share", share, "recall", len(want & exact) / len(want), "by refined codes", len(want & coded) / len(want))
    assert share <= 0.1
    assert len(want & exact) >= 0.9 * len(want) and len(want & coded) >= 0.9 * len(want)


def test_work_space_does_not_grow_with_the_batch():
    import tracemalloc

    import pyarrow as pa
    r = np.random.default_rng(2)
    tree = C.CellTree([r.standard_normal((16, 64)), r.standard_normal((256, 64))])
    x = r.standard_normal((4000, 64))
    tracemalloc.start()
    got = tree.nearest(x, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak  # the gathered centres of all rows would be 4000 * 128 * 64 numbers, 262 MB
    assert (got == np.concatenate([tree._nearest(x[a:a + 7], 1, C.BEAM) for a in range(0, 4000, 7)])).all()
    # a query's copies grow with the blocks, what a task holds does not
    counts = np.full(256, 5000)
    first, blocks = C.block_plan(counts, 5000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), C._lists(x)], ["id", "_qv"])
    parts = list(C._spread_queries(tree, 144, first, blocks, counts, 256)([batch]))
    assert sum(p.num_rows for p in parts) == 4000 * 144
    assert max(p.num_rows for p in parts) * 64 <= C.WORK
