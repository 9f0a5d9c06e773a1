"""A file stream of JSON lines (plain and zstd) gives the batch result."""

import json
import os

import zstandard as zstd
from pyspark.sql import functions as F

from subjex.functions.text import assemble_text, prompt_text
from subjex.sources.sinks import CORPUS_SCHEMA, read_jsonl
from subjex.streaming.stream import read_stream, stream_to_table


def test_json_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    recs = [{"id": f"r{i}", "title": f"Title {i}", "abstract": f"Abstract {i}", "language": "de" if i % 2 else "en",
             "type": "Book", "gnd_subject_ids": [], "linsearch_codes": []} for i in range(40)]
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs[:20]) + "\n")
    with open(os.path.join(src, "b.jsonl.zst"), "wb") as f:
        f.write(zstd.ZstdCompressor().compress(("\n".join(json.dumps(r) for r in recs[20:]) + "\n").encode()))

    def shape(df):
        return df.select("id", assemble_text("title", "abstract").alias("text"),
                         prompt_text("title", "abstract", "language", "type").alias("prompt"))

    streamed = stream_to_table(spark, shape(read_stream(spark, src, CORPUS_SCHEMA, "json")), "t-json")
    batch = shape(read_jsonl(spark, src))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() == 40 and streamed.where(F.col("text") == "").count() == 0


def test_stream_over_a_table_of_many_files(spark, tmp_dir):
    from subjex.streaming.stream import stream_to_table, table_stream
    spark.range(40).repartition(4).write.parquet(tmp_dir + "/many.parquet")
    spark.range(7).coalesce(1).write.parquet(tmp_dir + "/other.parquet")
    out = stream_to_table(spark, table_stream(spark, tmp_dir, "many", "id BIGINT"), "many-files")
    assert sorted(r["id"] for r in out.collect()) == list(range(40))


def test_tree_is_converted_file_by_file(spark, tmp_dir):
    """A second run takes only new files, a killed one is finished without repeats, exclusions
    and the empty guard hold; the records are those of the batch conversion."""
    import json
    import os
    import shutil

    import pytest

    from subjex.sources import jsonld as J
    from subjex.streaming.stream import convert_tree
    raw, out, ckpt = (os.path.join(tmp_dir, x) for x in ("raw", "out", "ckpt"))

    def put(name, title, body=None):
        os.makedirs(os.path.dirname(os.path.join(raw, name)), exist_ok=True)
        doc = {"@graph": [{"@id": "x"}, {"@type": "bibo:Book", "title": title, "language": "http://l/de"}]}
        with open(os.path.join(raw, name), "w") as f:
            f.write(body if body is not None else json.dumps(doc))
    titles = lambda df: sorted(r["title"] for r in df.collect())
    os.makedirs(raw)
    with pytest.raises(ValueError, match="no .*files"):
        convert_tree(spark, raw, out, ckpt)
    put("a/3A1.jsonld", "one")
    put("a/b/3A2.v1.jsonld", "two")
    put("a/broken.jsonld", "", "{")
    put("a/note.txt", "no")
    put("c/gone.jsonld", "excluded")
    excl = os.path.join(tmp_dir, "excl.json")
    with open(excl, "w") as f:
        json.dump({"Records": ["raw/c/gone.jsonld"]}, f)
    assert titles(convert_tree(spark, raw, out, ckpt, excl)) == ["one", "two"]
    put("a/b/3A3.jsonld", "three")
    assert titles(convert_tree(spark, raw, out, ckpt, excl)) == ["one", "three", "two"]
    assert titles(convert_tree(spark, raw, out, ckpt, excl)) == ["one", "three", "two"]  # nothing new
    # a run killed after writing its part, before its commit: the files are taken again, once
    put("d/3A4.jsonld", "four")
    assert titles(convert_tree(spark, raw, out, ckpt, excl)) == ["four", "one", "three", "two"]
    commits = sorted((int(x) for x in os.listdir(os.path.join(ckpt, "commits")) if x.isdigit()))
    os.remove(os.path.join(ckpt, "commits", str(commits[-1])))
    crc = os.path.join(ckpt, "commits", f".{commits[-1]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    again = convert_tree(spark, raw, out, ckpt, excl)
    assert titles(again) == ["four", "one", "three", "two"]
    batch = J.build_corpus(spark, raw, excl)
    assert sorted(map(str, again.collect())) == sorted(map(str, batch.select(*again.columns).collect()))
    shutil.rmtree(os.path.join(raw, "a"))  # converted records stay
    assert len(titles(convert_tree(spark, raw, out, ckpt, excl))) == 4
