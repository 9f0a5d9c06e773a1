import random

import corpus_pipeline
from helpers import prose, sets
from pyspark.sql import functions as F

import __spark_entry__ as E
from subjex.session import written


def corpus(spark, path):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        t = prose(i, r.randrange(60, 120), 5000)
        bad = i % 4 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        docs.append((i, t))
        if i % 10 < 8:
            labels.append((i, 0 if bad else 1, 0))
    docs += [(500, docs[1][1]), (501, docs[2][1] + " one more word"), (502, f"{prose(777, 80, 5000)} password=hunter2hunter2 end"),
             (503, prose(778, 70, 5000) + " " + prose(999, 40, 5000) + " tail"), (504, None), (None, prose(779, 80, 5000)), (503, prose(780, 90, 5000))]
    rows = [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _found string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 40, 5000)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_each_stage_does_its_work(spark, tmp_dir):
    corpus(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, tmp_dir), "test")
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = lambda df: sorted(str(r[0]) for r in df.select("doc_id").collect())
    # quality: upper-case junk goes, the rest stays
    before, after = kept[0]
    left = {str(r["doc_id"]) for r in after.collect()}
    assert not left & {str(i) for i in range(0, 400, 4)} and len({str(i) for i in range(400) if i % 4} - left) <= 3
    # near copies: the smallest id of each group stays
    before, after = kept[1]
    texts = [(r["doc_id"], sets(r["text"])) for r in before.collect()]
    gone = {str(i) for i, s in texts for j, x in texts if i is not None and j is not None and j < i and s and 100 * len(s & x) >= 80 * len(s | x)}
    assert {"500", "501"} <= gone and set(ids(before)) - set(ids(after)) == gone
    # the leaked row goes (the other row of its id stays)
    before, after = kept[2]
    assert before.count() - after.count() == 1 and not after.where(F.contains("text", F.lit(prose(999, 40, 5000)))).count()
    # secrets are replaced, nothing else changes
    before, after = kept[3]
    assert ids(before) == ids(after)
    row = after.where("doc_id = 502").first()
    assert "hunter2" not in row["text"] and "[SECRET]" in row["text"] and row["n_chars"] == len(row["text"])
    assert after.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old and doc_id not in (502, 503)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tmp_dir)
    assert sorted({str(r[0]) for r in packed.select("doc_id").collect()}) == sorted(set(ids(docs)))
    assert corpus_pipeline.run(spark, tmp_dir).count() == packed.count()


def test_registered():
    names = E.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
