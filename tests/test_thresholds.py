"""Threshold fitting against brute force."""

import numpy as np

from subjex.operators import thresholds as TH


def brute_c5(y, p):
    ts = sorted(set(p))
    pos = sum(y)
    best, best_t = -1.0, 0.5
    for t in ts:  # ascending: the first maximum is the lowest threshold
        sel = [yy for yy, pp in zip(y, p) if pp >= t]
        tps, fps = sum(sel), len(sel) - sum(sel)
        prec = tps / (tps + fps) if tps + fps else 0.0
        rec = tps / pos if pos else 1.0
        f1 = 2 * prec * rec / (prec + rec + 1e-9)
        if f1 > best:
            best, best_t = f1, t
    return best_t


def brute_c6(y, p):
    best_t, best_f1 = 0.5, 0.0
    for t in TH.GRID:
        tp = sum(1 for yy, pp in zip(y, p) if yy and pp >= t)
        pred = sum(1 for pp in p if pp >= t)
        den = sum(y) + pred
        f1 = 2 * tp / den if den else 0.0
        if f1 > best_f1:
            best_t, best_f1 = t, f1
    return best_t


def _long(spark, n_classes=6, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_classes):
        p = np.round(rng.random(n), 2)  # many ties
        y = (rng.random(n) < (0.0 if c == 0 else p * 0.8)).astype(int)
        rows += [(i, c, float(p[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id INT, class_idx INT, p DOUBLE, y INT"), rows


def test_exact_and_grid_match_brute_force(spark, monkeypatch):
    df, rows = _long(spark)
    by = {}
    for _, c, p, y in rows:
        by.setdefault(c, ([], []))
        by[c][0].append(y)
        by[c][1].append(p)
    original = TH.pr_sweep
    for buckets in (TH.PREFIX_BUCKETS, 7, 61):  # several range buckets per class
        monkeypatch.setattr(TH, "pr_sweep", lambda d, b=buckets: original(d, b))
        exact = {r["class_idx"]: r["threshold"] for r in TH.fit_thresholds_exact(df).collect()}
        for c, (y, p) in by.items():
            assert exact[c] == brute_c5(y, p)
    grid = {r["class_idx"]: r["threshold"] for r in TH.fit_thresholds_grid(df).collect()}
    for c, (y, p) in by.items():
        assert grid[c] == brute_c6(y, p)
    # a class without positives gets its lowest probability (every record positive)
    assert exact[0] == min(by[0][1])


def test_exact_f1_not_below_grid_f1(spark):
    df, _ = _long(spark, seed=11)
    sweep = TH.pr_sweep(df)
    best = {r["class_idx"]: r["f"] for r in sweep.groupBy("class_idx").agg({"f1": "max"})
            .withColumnRenamed("max(f1)", "f").collect()}
    grid = {}
    for r in TH.grid_f1(df).collect():
        grid[r["class_idx"]] = max(grid.get(r["class_idx"], 0.0), r["f1"])
    for c in best:
        assert best[c] >= grid[c] - 1e-8


def test_no_positive_option(spark):
    df, rows = _long(spark)
    half = {r["class_idx"]: r["threshold"] for r in TH.fit_thresholds_exact(df, no_positive="half").collect()}
    assert half[0] == 0.5  # class 0 has no positives


def test_sweep_does_not_hang_on_exchange_reuse_or_adaptive_plans(spark):
    """A million distinct probabilities: the same counts whatever the optimiser reuses."""
    from subjex.operators.thresholds import pr_sweep
    df = spark.range(1_000_000).selectExpr(
        "cast(id % 3 as int) as class_idx", "(id * 7919 % 1000003) / 1000003D as p", "cast(id * 31 % 5 = 0 as int) as y")
    states = []
    for reuse in ("true", "false"):
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            try:
                states.append(tuple(pr_sweep(df).selectExpr(
                    "count(*)", "sum(tps)", "sum(fps)", "bit_xor(xxhash64(class_idx, threshold, tps, fps))").first()))
            finally:
                spark.conf.unset("spark.sql.exchange.reuse")
                spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(set(states)) == 1 and states[0][0] == 1_000_000
    # ranks by one global window are the truth
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    w = Window.partitionBy("class_idx").orderBy(F.col("p").desc())
    want = df.withColumn("n", F.row_number().over(w)).agg(F.sum("n")).first()[0]
    assert states[0][1] + states[0][2] == want
