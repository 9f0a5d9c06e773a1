"""Columns of the caller, named like any name used inside, keep their values."""

import corpus_pipeline
import pytest
from helpers import prose
from pyspark.sql import functions as F

from subjex.llm import common

NAMES = ["row", "kept", "expected_grade", "p_top", "grade", "marks", "anchor", "leaks", "leaks_", "lower", "_new", "_lower", "shard",
         "found", "spans", "_found", "_text", "clean", "n", "rep", "th", "key", "component_id", "comp", "node", "sequence_id", "item_id", "score"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash"))
    docs = [(i, prose(i, 80, 5000) if i % 4 else " ".join(w.upper() + "!!" for w in prose(i, 80, 5000).split())) for i in range(120)]
    docs += [(200, prose(1, 80, 5000) + " end"), (201, prose(2, 80, 5000) + " secret=hunter2hunter2"), (202, prose(999, 60, 5000)), (203, None)]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c} {i}" for c in NAMES]) for i, t in docs]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    spark.createDataFrame(rows, shape).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 60, 5000))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("number", range(4))
def test_stage_keeps_the_values(spark, folder, number):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[number][1](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) > 60
    for r in got:
        assert [r[c] for c in NAMES] == [f"{c} {r['doc_id']}" for c in NAMES]


def test_results_replace_columns_of_their_name(spark, folder):
    from subjex.llm.decontaminate import find_leaks
    from subjex.llm.ordinal import classify
    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    judged = classify(docs, labels, ["doc_id", "kept", "grade"])
    assert judged.columns == ["doc_id", "grade", "expected_grade", "p_top", "kept"] and dict(judged.dtypes)["kept"] == "boolean"
    assert find_leaks(docs, items).where(F.size("leaks") > 0).select("doc_id").collect()[0][0] == 202


def test_fresh():
    assert common.fresh("a", ["A", "a_"]) == "a__" and common.fresh("b", ["a"]) == "b"
