"""Metrics against brute force; micro scores do not depend on class order."""

import numpy as np

from subjex.operators.metrics import align, classification_report, confusion, micro_macro


def _data(spark, perm=None, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random((60, 8)) < 0.3).astype(int)
    p = (rng.random((60, 8)) < 0.3).astype(int)
    p[:, 7] = 0  # a class never predicted
    y[:, 6] = 0  # a class never true
    if perm is not None:
        y, p = y[:, perm], p[:, perm]
    gold = spark.createDataFrame([(i, [int(v) for v in y[i]]) for i in range(60)], "id INT, y ARRAY<INT>")
    pred = spark.createDataFrame([(i, [int(v) for v in p[i]]) for i in range(60)],
                                 "id INT, labels ARRAY<INT>")
    return y, p, align(pred, gold, "id")


def test_micro_macro_brute_force(spark):
    y, p, al = _data(spark)
    m = micro_macro(confusion(al)).first()
    tp = (y * p).sum(0)
    pred, true = p.sum(0), y.sum(0)
    prec = np.where(pred > 0, tp / np.maximum(pred, 1), 0.0)
    rec = np.where(true > 0, tp / np.maximum(true, 1), 0.0)
    f1 = np.where(true + pred > 0, 2 * tp / np.maximum(true + pred, 1), 0.0)
    assert abs(m["micro_f1"] - 2 * tp.sum() / (true.sum() + pred.sum())) < 1e-12
    assert abs(m["micro_precision"] - tp.sum() / pred.sum()) < 1e-12
    assert abs(m["macro_f1"] - f1.mean()) < 1e-12
    assert abs(m["macro_precision"] - prec.mean()) < 1e-12
    assert abs(m["macro_recall"] - rec.mean()) < 1e-12
    rep = {r["label"]: r for r in classification_report(al).collect()}
    assert set(rep) >= {"micro avg", "macro avg", "weighted avg", "samples avg"}
    assert rep["weighted avg"]["support"] == int(true.sum())


def test_micro_invariant_under_class_permutation(spark):
    perm = [3, 1, 7, 0, 6, 2, 5, 4]
    _, _, a = _data(spark)
    _, _, b = _data(spark, perm)
    ma, mb = micro_macro(confusion(a)).first(), micro_macro(confusion(b)).first()
    for k in ("micro_f1", "micro_precision", "micro_recall", "macro_f1"):
        assert abs(ma[k] - mb[k]) < 1e-12


def test_missing_prediction_counts_as_nothing(spark):
    from subjex.operators.metrics import evaluate
    gold = spark.createDataFrame([(1, [1, 0]), (2, [0, 1])], "id int, y array<int>")
    pred = spark.createDataFrame([(1, [1, 0])], "id int, labels array<int>")
    m = evaluate(pred, gold, "id").first()
    assert m["micro_recall"] == 0.5 and m["micro_precision"] == 1.0 and abs(m["micro_f1"] - 2 / 3) < 1e-12


def test_prediction_without_gold_is_an_error(spark):
    import pytest
    from subjex.operators.metrics import evaluate
    gold = spark.createDataFrame([(1, [1, 0])], "id int, y array<int>")
    pred = spark.createDataFrame([(1, [1, 0]), (3, [1, 0])], "id int, labels array<int>")
    with pytest.raises(Exception, match="prediction without gold: 3"):
        evaluate(pred, gold, "id").collect()


def test_logits_are_placed_by_class(spark):
    import pytest
    from subjex.operators.ensemble import ensemble_logits, prob_arrays
    full = spark.createDataFrame([(1, 2, 0.9), (1, 0, 0.1), (1, 1, 0.5)], "id int, class_idx int, prob double")
    assert prob_arrays(full).first()["probs"] == [0.1, 0.5, 0.9]
    with pytest.raises(Exception, match="missing class: record 1"):
        prob_arrays(full.where("class_idx <> 1")).collect()
    logits = spark.createDataFrame([(0, 1, 0, 1.0), (1, 1, 0, 3.0), (0, 1, 1, 2.0)], "model_id int, id int, class_idx int, logit double")
    assert ensemble_logits(logits.where("class_idx = 0")).first()["logit"] == 2.0
    with pytest.raises(Exception, match="missing logit of a model: record 1"):
        ensemble_logits(logits).collect()


def test_classes_without_a_name_stay_in_the_report(spark):
    from subjex.operators.metrics import classification_report
    aligned = spark.createDataFrame([(1, [1, 0], [1, 0])], "id int, y array<int>, yhat array<int>")
    names = spark.createDataFrame([(0, "first")], "class_idx int, class string")
    labels = {r["label"] for r in classification_report(aligned, names).collect()}
    assert {"first", "1"} <= labels
