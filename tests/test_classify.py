"""Model fitting: Spark's optimum is the optimum of the reference objective."""

import numpy as np

from subjex.operators.classify import LR_C, fit_one_vs_rest, predict_proba
from subjex.plans import fixtures as fx
from testdata_paths import SF_SMALL


def test_gradient_of_reference_objective_is_zero(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    g = fx.gold(spark, SF_SMALL)
    data = e.join(g, e.vec_id == g.id).select("id", "embedding", "y")
    # class 9 gets no positives: a constant model
    data = data.selectExpr("id", "embedding", "transform(y, (v, i) -> if(i = 9, 0, v)) as y")
    model = fit_one_vs_rest(data, "embedding", "y", 10, max_iter=1000, tol=1e-10)
    rows = data.orderBy("id").collect()
    X = np.array([r["embedding"] for r in rows], dtype=np.float64)
    Y = np.array([r["y"] for r in rows])
    for j in range(9):
        y = Y[:, j]
        n, pos = len(y), y.sum()
        s = np.where(y == 1, n / (2.0 * pos), n / (2.0 * (n - pos)))
        w, b = model.coefficients[j], model.intercepts[j]
        p = 1 / (1 + np.exp(-(X @ w + b)))
        # sklearn objective: 0.5 |w|^2 + C * sum_i s_i * logloss_i
        grad_w = w + LR_C * X.T @ (s * (p - y))
        grad_b = LR_C * np.sum(s * (p - y))
        scale = LR_C * n
        assert np.abs(grad_w).max() / scale < 1e-4
        assert abs(grad_b) / scale < 1e-4
    probs = predict_proba(data, "embedding", model).orderBy("id").collect()
    assert all(r["probs"][9] == 0.0 for r in probs)


def test_encoder_is_fitted_once(spark, tmp_dir):
    """The same text gets the same vector in any table, also after a round trip."""
    from subjex.operators.classify import HashingEncoder
    fit = HashingEncoder.fit(spark.createDataFrame([("x y z",), ("y z",), ("q",)], "t string"), "t", dim=64)
    fit.save(tmp_dir + "/enc")
    a = fit.transform(spark.createDataFrame([("x y",)], "t string"), "t").first()["embedding"]
    b = HashingEncoder.load(tmp_dir + "/enc").transform(spark.createDataFrame([("w",), ("x y",)], "t string"), "t").where("t = 'x y'").first()["embedding"]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6


def test_newton_and_lbfgs_find_the_same_optimum(spark, monkeypatch):
    """All classes in one loop: the passes do not grow with the classes, both methods agree."""
    from subjex.operators import classify as C
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 5))
    y = (x @ r.normal(size=(5, 6)) + r.normal(size=(300, 6)) > 0.5).astype(int)
    rows = [(x[i].tolist(), y[i].tolist()) for i in range(300)]
    data = spark.createDataFrame(rows, "f array<double>, y array<int>").repartition(3)
    newton = C.fit_one_vs_rest(data, "f", "y", 6, tol=1e-9)
    passes = []
    real = C._loss_sums
    monkeypatch.setattr(C, "_loss_sums", lambda *a: passes.append(1) or real(*a))
    C.fit_one_vs_rest(data, "f", "y", 2)
    few = len(passes)
    C.fit_one_vs_rest(data, "f", "y", 6)
    assert len(passes) - few <= few + 3 <= 15
    monkeypatch.setattr(C, "MAX_HESSIAN", 0)
    other = C.fit_one_vs_rest(data, "f", "y", 6, tol=1e-7)
    assert np.allclose(newton.coefficients, other.coefficients, atol=1e-3) and np.allclose(newton.intercepts, other.intercepts, atol=1e-3)


def test_constant_classes_and_empty_table(spark):
    data = spark.createDataFrame([([1.0, 2.0], [0, 1, 1]), ([2.0, 1.0], [0, 1, 0])], "f array<float>, y array<int>")
    m = fit_one_vs_rest(data, "f", "y", 3)
    assert m.intercepts[0] == -np.inf and m.intercepts[1] == np.inf and np.isfinite(m.intercepts[2])
    assert fit_one_vs_rest(data.limit(0), "f", "y", 2).coefficients.shape == (2, 0)
