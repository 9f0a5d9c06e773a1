"""Golden tests of JSON-LD record building on inline documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from subjex.sources import jsonld as J

MARK = "(classificationName=linsearch:mapping)"


def _docs(spark, items):
    return spark.createDataFrame(items, "file_name STRING, doc STRING")


def _node(**kw):
    base = {"@type": "bibo:Article", "title": "T", "language": "http://id.loc.gov/vocabulary/iso639-1/de"}
    base.update(kw)
    return base


def _doc(*nodes):
    # pretty-printed: a document spans many lines, as real JSON-LD files do
    return json.dumps({"@graph": [{"@id": "_:b0"}, *nodes]}, indent=2)


def _extract(spark, items):
    rows = J.extract_records(J.parse_documents(_docs(spark, items))).collect()
    return {r["id"]: r for r in rows}


def test_subject_shapes(spark):
    recs = _extract(spark, [
        ("a.jsonld", _doc(_node(**{"dcterms:subject": {"@id": "gnd:123"}}))),
        ("b.jsonld", _doc(_node(**{"dcterms:subject": [{"@id": "gnd:1"}, "skip", {"x": 1},
                                                       {"@id": "gnd:2"}, {"@id": "gnd:1"}]}))),
        ("c.jsonld", _doc(_node())),
        ("d.jsonld", _doc(_node(**{"dcterms:subject": {"@id": ""}}))),
    ])
    assert recs["a"]["gnd_subject_ids"] == ["123"]
    assert recs["b"]["gnd_subject_ids"] == ["1", "2", "1"]  # order and repeats kept
    assert recs["c"]["gnd_subject_ids"] == []
    assert recs["d"]["gnd_subject_ids"] == []  # empty object id is dropped


def test_domain_codes(spark):
    recs = _extract(spark, [
        ("a.jsonld", _doc(_node(subject=f"{MARK}c1 "))),
        ("b.jsonld", _doc(_node(subject=["(classificationName=other)x", f"{MARK}rest", f"{MARK} c2",
                                         f"(a){MARK}(b)c3"]))),
        ("c.jsonld", _doc(_node())),
    ])
    assert recs["a"]["linsearch_codes"] == ["c1"]
    assert recs["b"]["linsearch_codes"] == ["c2", "c3"]
    assert recs["c"]["linsearch_codes"] == []


def test_main_node_language_type_and_ids(spark):
    recs = _extract(spark, [
        ("x.v1.jsonld", _doc({"@type": "bibo:Book"}, _node(**{"@type": "bibo:Thesis", "title": "Main",
                                                                "language": "http://x/iso/en/"}))),
        ("y.jsonld", _doc(_node(language=""))),
        ("z.jsonld", _doc(_node(**{"@type": ["bibo:Report", "x:Y"]}, abstract=["a", "b"]))),
    ])
    assert set(recs) == {"x.v1", "y", "z"}
    assert recs["x.v1"]["type"] == "Thesis" and recs["x.v1"]["title"] == "Main"
    assert recs["x.v1"]["language"] == "en"
    assert recs["y"]["language"] == "und"
    assert recs["y"]["abstract"] == ""
    assert recs["z"]["type"] == "Report"  # list-valued type: first element
    assert recs["z"]["abstract"] == "a b"


def test_broken_and_without_main_node(spark):
    docs = _docs(spark, [("ok.jsonld", _doc(_node())), ("bad.jsonld", '{"@graph": ['),
                         ("none.jsonld", _doc({"@type": "x:A"}, {"title": "only title"})),
                         ("empty.jsonld", json.dumps({"x": 1}))])
    parsed = J.parse_documents(docs)
    assert [r["file_name"] for r in J.rejects(parsed).collect()] == ["bad.jsonld"]
    assert [r["id"] for r in J.extract_records(parsed).collect()] == ["ok"]


def test_file_scan_exclusion_and_empty_guard(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(os.path.join(raw, "sub", "deeper"))
    files = {"sub/a.jsonld": _doc(_node(title="A")), "sub/deeper/b.jsonld": _doc(_node(title="B")),
             "c.jsonld": _doc(_node(title="C")), "ignored.json": _doc(_node(title="D"))}
    for name, text in files.items():
        with open(os.path.join(raw, name), "w") as f:
            f.write(text)
    excl = os.path.join(tmp_dir, "excl.json")
    with open(excl, "w") as f:
        json.dump({"Records": ["/some/where/c.jsonld", "x/c.jsonld"]}, f)
    out = J.build_corpus(spark, raw, exclude=excl)
    assert sorted(r["title"] for r in out.collect()) == ["A", "B"]
    assert [r["file_name"] for r in J.read_exclusions(spark, excl).collect()] == ["c.jsonld"]
    empty = os.path.join(tmp_dir, "empty")
    os.makedirs(empty)
    with open(os.path.join(empty, "note.txt"), "w") as f:
        f.write("x")
    with pytest.raises(ValueError):
        J.build_corpus(spark, empty)


def test_record_id_rule(spark):
    from subjex.functions.records import record_id
    df = spark.createDataFrame([("a.b.c",), (".hidden",), ("plain",)], "f STRING")
    got = [r[0] for r in df.select(record_id("f")).collect()]
    assert got == ["a.b", ".hidden", "plain"]


def test_vocabulary_entries(spark, tmp_dir):
    from subjex.sources import vocab as V
    path = os.path.join(tmp_dir, "subjects.json")
    with open(path, "w") as f:
        json.dump([
            {"Code": "gnd:4003694-7", "Name": "Alpha", "Alternate Name": ["A1", "A2"],
             "Classification Name": "Cls", "Definition": "Def"},
            {"Code": "", "Name": "no code"},
            {"Code": "gnd:9", "Name": "", "Alternate Name": ["Alt"]},
            {"Code": "gnd:10", "Name": "  "},
            {"Code": "x:4003694-7", "Name": "Alpha again"},
        ], f)
    idx = {r["gnd_id"]: r for r in V.label_index(V.read_vocabulary(spark, path)).collect()}
    assert idx["4003694-7"]["label_text"] == "Alpha again"  # last wins
    assert idx["9"]["label_text"] == ". Alt"
    assert idx["9"]["emb_text"] == "passage: . Alt"
    assert "10" not in idx
    entries = V.vocabulary_entries(V.read_vocabulary(spark, path)).orderBy("pos").collect()
    assert entries[0]["label_text"] == "Alpha. A1 | A2. Cls. Definition: Def"


def test_class_list_and_code_map(spark, tmp_dir):
    from subjex.sources import vocab as V
    p = os.path.join(tmp_dir, "classes.txt")
    with open(p, "w") as f:
        f.write(" a \n\n b\n  \nc\n")
    assert [(r[0], r[1]) for r in V.read_class_list(spark, p).collect()] == [(0, "a"), (1, "b"), (2, "c")]
    kept = V.read_class_list(spark, p, keep_blank=True).collect()
    assert [r["class"] for r in kept][:3] == ["a", "", "b"]
    m = os.path.join(tmp_dir, "map.json")
    with open(m, "w") as f:
        json.dump({"x": 1, "y": 0}, f)
    assert sorted((r["class"], r["class_idx"]) for r in V.read_code_map(spark, m).collect()) == \
        [("x", 1), ("y", 0)]
