import random

import numpy as np
from helpers import prose, table

from subjex.llm import ordinal


def corpus(n, seed):
    r = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        g = r.choice((0, 1, 2, 2, 2))
        w = prose(seed * 100_000 + i, r.randrange(20, 300), 3000).split()
        if g == 0:
            w = [x.upper() + "!!" if r.random() < 0.9 else x for x in w] if i % 2 else [x + r.choice(("***", "$$$")) for x in w]
        if g == 1:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(("vilest", "rotten.", "Wretch,")))
        rows.append((i, " ".join(w)))
        grades.append((i, g))
    return rows, grades


def test_held_out_grades(spark):
    rows, grades = corpus(1500, 1)
    more, truth = corpus(400, 2)
    model = ordinal.fit(table(spark, rows), spark.createDataFrame(grades, "doc_id long, grade int"), 3)
    marks, weights, theta = model
    assert len(theta) == 2 and theta[0] < theta[1] and (weights[marks >= ordinal.RATIOS] <= 0).all()
    odd = [(900, None), (901, ""), (902, "x"), (0, more[0][1]), (None, prose(8, 40_000))]
    got = ordinal.score(table(spark, more + odd), model, ["doc_id", "key"]).collect()
    assert len(got) == len(more) + len(odd) and got[0]["key"] == "key"
    by = {}
    for r in got:
        assert 0 <= r["p_top"] <= 1 and 0 <= r["expected_grade"] <= 2
        by.setdefault(r["doc_id"], set()).add(r["p_top"])
    assert len(by[0]) == 1  # repeated rows score alike
    right = sum((max(by[i]) >= 0.5) == (g == 2) for i, g in truth)
    assert right / len(truth) > 0.97
    means = [np.mean([r["expected_grade"] for r, (i, g) in zip(sorted((x for x in got[:400]), key=lambda x: x["doc_id"]), truth) if g == k]) for k in (0, 1, 2)]
    assert means[0] < means[1] < means[2]


def test_gradient_is_that_of_the_likelihood():
    """At the fit no weight or threshold can be moved to a better penalised likelihood."""
    r = np.random.default_rng(0)
    n = 400
    grade = r.integers(0, 3, n)
    level = np.where(r.random(n) < 0.8, grade, r.integers(0, 3, n))
    marks, before = level.astype(np.int64), np.arange(n + 1)
    used, w, theta = ordinal.fit_arrays(marks, before, grade, 3, steps=4000)

    def loss(w, theta):
        f = w[np.searchsorted(used, marks)]
        cum = np.c_[np.zeros(n), ordinal._sigmoid(theta[None] - f[:, None]), np.ones(n)]
        return -np.log(cum[np.arange(n), grade + 1] - cum[np.arange(n), grade]).sum() + 0.05 * (w ** 2).sum()
    best = loss(w, theta)
    for i in range(len(w)):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(len(w)) == i), theta) > best - 1e-3
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, theta + d * (np.arange(2) == i)) > best - 1e-3


def test_one_grade_no_labels_and_empty(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels.where("quality = 1"), labels.where("doc_id = 2"), labels.limit(0)):
        got = ordinal.classify(docs, some, ["doc_id"]).collect()
        assert [r["kept"] for r in got] == [True, True]
    assert ordinal.classify(docs.limit(0), labels, ["doc_id", "text"]).count() == 0
    assert ordinal.classify(docs, labels, ["doc_id", "text"]).columns == ["doc_id", "text", "expected_grade", "p_top", "kept"]
    grades = {r["doc_id"]: r["grade"] for r in ordinal.grades_from_labels(
        spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, None), (6, None, None)], "doc_id long, quality int, toxic int")).collect()}
    assert grades == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: None}


def test_marks_are_made_in_many_tasks(spark, monkeypatch):
    def marks(batches):  # the task's number as the anchor
        import pyarrow as pa
        from pyspark import TaskContext
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([TaskContext.get().partitionId()] * n, pa.int64()),
                                              pa.array([[]] * n, pa.list_(pa.int64()))], ["grade", "anchor", "marks"])

    def fitted(grades, min_docs):
        def run(batches):
            import pyarrow as pa
            tasks = sorted({x for b in batches for x in b.column("anchor").to_pylist()})
            yield pa.RecordBatch.from_pydict({"marks": [tasks], "weights": [[0.0]], "theta": [[0.0]]})
        return run
    monkeypatch.setattr(ordinal, "_marks", marks)
    monkeypatch.setattr(ordinal, "_fit", fitted)
    docs = table(spark, [(i, f"w{i}") for i in range(200)]).repartition(4)
    tasks = ordinal.fit(docs, spark.createDataFrame([(i, i % 3) for i in range(200)], "doc_id long, grade int"), 3)[0]
    assert len(tasks) == 4
