import zlib

import numpy as np
from helpers import table

from subjex.llm import common, sharding


def test_curve_visits_all_cells_in_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1).max() == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_equal_rows_per_shard(spark, monkeypatch):
    rows = [(i, "t" * (i % 50), ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 9}", i % 50) for i in range(500)]
    rows += [(7, None, None, None, None)] * 5 + [(None, "é", "en", "hot", 1)] * 4
    monkeypatch.setattr(common.ranked, "__defaults__", (40,))  # several buckets in a cell
    df = table(spark, rows, SCHEMA).drop("cell", "rank")
    got = sharding.place(df, ["lang", "source", "n_chars"], shards=40).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40)) and {len(s) for s in slots.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = lambda t: (t or "").encode()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(a), len(text(t)) + 16, zlib.crc32(text(t))) for a, t, *_ in rows)
    cells = sorted((r["shard"], r["slot"], r["cell"]) for r in got)
    assert [c[2] for c in cells] == sorted(c[2] for c in cells)  # shards are runs of the curve


def test_few_rows_empty_table_and_files(spark, tmp_dir):
    df = table(spark, [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], SCHEMA, clash=False)
    assert {(r["shard"], r["slot"]) for r in sharding.place(df, ["lang", "source"]).collect()} == {(0, 0), (20, 0)}
    assert sharding.place(df.where("doc_id < 0"), ["lang", "source"]).count() == 0
    sharding.write_sorted(df, tmp_dir + "/out", ["lang", "n_chars"], 2)
    assert sorted(r["doc_id"] for r in spark.read.parquet(tmp_dir + "/out").collect()) == [1, 2]


def test_strings_are_compared_whole(spark):
    """Values that share a long beginning fall into cells of their own; cuts are true quantiles."""
    rows = [(i, "t", f"https://host{i % 7}.org/{'x' * (i % 7)}", "s", 1) for i in range(140)]
    got = sharding.place(table(spark, rows, SCHEMA, clash=False), ["lang"], shards=7).collect()
    assert len({r["cell"] for r in got}) == 7
    r = np.random.default_rng(1)
    values = [f"common/beginning/{int(x):05d}" for x in r.integers(0, 900, 3000)] + ["é", "", "common"] * 10
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").repartition(4)
    cuts = sharding.string_cuts(df, "v", 32)
    ordered = sorted(values, key=lambda v: v.encode())
    want = {ordered[-(-i * len(values) // 32) - 1] for i in range(1, 33)}
    assert cuts == sorted(want, key=lambda v: v.encode())


def test_hot_cell_is_spread_over_files(spark, tmp_dir):
    df = table(spark, [(i, f"t{i}", "en", "hot", 1) for i in range(90)] + [(i, "u", "de", "s", 2) for i in range(90, 100)], SCHEMA)
    sharding.write_sorted(df, tmp_dir + "/hot", ["lang", "source"], 5)
    back = spark.read.parquet(tmp_dir + "/hot")
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {20}
    assert back.where("lang = 'de'").select("shard").distinct().count() == 1
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(100))
