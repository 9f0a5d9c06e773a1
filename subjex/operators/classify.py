"""Text embedding and one-vs-rest logistic regression.

Training fits all classes of a one-vs-rest logistic regression together, with
balanced instance weights and the reference's objective (0.5 |w|^2 + C * weighted
loss, intercept free): one distributed pass an iteration sums the losses,
gradients and, while they are small, Hessians of every class, and each class
takes its own Newton or L-BFGS step.  The number of jobs does not depend on the
number of classes.

Scoring multiplies each Arrow batch of feature rows with the coefficient matrix
(classes x dim, bounded by the class count) in one pandas UDF: all classes in
one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjex.functions.text import whitespace_tokens
from subjex.operators.encoders import chunked, summed
from subjex.session import ship_package, written

# The reference's classifier settings.
LR_C = 10.0
LR_MAX_ITER = 1000
# Bound on coefficients shipped with the scoring function (classes x dim).
MAX_COEFFICIENTS = 50_000_000

Encoder = Callable[[list[str]], np.ndarray]


# ---------------------------------------------------------------------------
# embedding

class HashingEncoder:
    """C1 built-in encoder: hashed term frequencies -> IDF -> L2 norm, as an array.

    Fit once, transform many: documents, queries and labels share one set of weights, so
    their vectors are comparable.  Needs no model files; it is a lexical encoder, not a
    substitute for a neural one.
    """

    def __init__(self, model):
        self.model = model

    @staticmethod
    def fit(df: DataFrame, text_col: str, dim: int = 1024, normalize: bool = True) -> "HashingEncoder":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer

        stages = [HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim), IDF(inputCol="_tf", outputCol="_idf")]
        if normalize:
            stages.append(Normalizer(inputCol="_idf", outputCol="_norm", p=2.0))
        return HashingEncoder(Pipeline(stages=stages).fit(df.withColumn("_toks", whitespace_tokens(text_col))))

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        res = self.model.transform(df.withColumn("_toks", whitespace_tokens(text_col)))
        last = "_norm" if "_norm" in res.columns else "_idf"
        return res.withColumn(out, vector_to_array(last, "float32")).drop("_toks", "_tf", "_idf", "_norm")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "HashingEncoder":
        from pyspark.ml import PipelineModel
        return HashingEncoder(PipelineModel.load(path))


def embed_hashing(df: DataFrame, text_col: str, out: str = "embedding",
                  dim: int = 1024, normalize: bool = True) -> DataFrame:
    """Fit the built-in encoder on ``df`` and encode it (one table on its own)."""
    return HashingEncoder.fit(df, text_col, dim, normalize).transform(df, text_col, out)


def embed(df: DataFrame, text_col: str, make_encoder: Callable[[], Encoder], dim: int,
          out: str = "embedding", normalize: bool = True, batch_size: int = 256) -> DataFrame:
    """Any ``list[str] -> ndarray`` encoder through ``predict_batch_udf``.

    ``make_encoder`` runs once per Python worker (the model is loaded there, not
    on the driver); rows are encoded in Arrow batches of ``batch_size``.
    """
    from pyspark.ml.functions import predict_batch_udf

    ship_package(df.sparkSession)
    def loader():
        enc = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            vecs = np.asarray(enc(list(texts)), dtype=np.float32)
            if normalize:
                vecs = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
            return vecs
        return predict

    udf = predict_batch_udf(loader, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=[[]])
    return df.withColumn(out, udf(F.col(text_col)))


# ---------------------------------------------------------------------------
# A9 + C2 + C3: training

def balanced_instance_weights(df: DataFrame, label: str = "label", n: int | None = None,
                              pos: int | None = None) -> DataFrame:
    """``weight = n / (2 n_class)`` of the row's 0/1 label (global counts;
    computed here unless given)."""
    if n is None or pos is None:
        st = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).first()
        n, pos = int(st["n"]), int(st["pos"] or 0)
    neg = n - pos
    w_pos = n / (2.0 * pos) if pos else 0.0
    w_neg = n / (2.0 * neg) if neg else 0.0
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)))


@dataclass
class OvrModel:
    coefficients: np.ndarray  # classes x dim
    intercepts: np.ndarray    # classes; -inf for a class without positives
    n_classes: int


#: Numbers of all classes' Hessians up to which Newton steps are taken (a property of the
#: model: classes x (dimensions + 1) squared); L-BFGS beyond.
MAX_HESSIAN = 1 << 21
LBFGS_MEMORY = 10
#: Rows of a partial sum that travel together (of one number each).
_CHUNK = 1 << 15


def _loss_sums(w: np.ndarray, weights: np.ndarray, hessian: bool):
    """Sums over a task's rows (features, y), flat: per class the weighted log loss, its gradient
    by coefficients and intercept and, if asked, its Hessian.  ``weights``: classes x (negative,
    positive)."""
    def run(batches):
        c, d = w.shape
        total = np.zeros((c, 1 + d + d * d * hessian))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :c] == 1
            x = np.hstack([x, np.ones((len(x), 1))])
            s = np.where(y, weights[:, 1], weights[:, 0])
            z = x @ w.T
            total[:, 0] += (s * (np.logaddexp(0, z) - y * z)).sum(axis=0)
            p = 0.5 * (1 + np.tanh(z / 2))
            total[:, 1:1 + d] += (s * (p - y)).T @ x
            if hessian:
                h = s * p * (1 - p)
                for j in range(c):
                    total[j, 1 + d:] += ((x * h[:, j:j + 1]).T @ x).ravel()
        yield chunked(total.reshape(-1, 1), _CHUNK)
    return run


class _Lbfgs:
    """Two-loop recursion over the last steps of one class."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, step: np.ndarray, change: np.ndarray) -> None:
        if step @ change > 1e-12 * (np.linalg.norm(step) * np.linalg.norm(change) + 1e-300):
            self.pairs = [*self.pairs, (step, change)][-LBFGS_MEMORY:]

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q


def _minimise(evaluate, classes: int, size: int, newton: bool, max_iter: int, tol: float) -> np.ndarray:
    """Minimise ``classes`` independent functions in lock step.  ``evaluate(points)`` returns all
    values, gradients and Hessians (or None) at one point a class; a class that is at its
    minimum (gradient at most ``tol``) stays, one whose value grew halves its step."""
    w = np.zeros((classes, size))
    f, g, h = evaluate(w)
    memory = [_Lbfgs() for _ in range(classes)]
    length = np.ones(classes)
    move = np.zeros_like(w)
    for _ in range(max_iter):
        todo = np.abs(g).max(axis=1) > tol
        if not todo.any():
            break
        for j in np.flatnonzero(todo & (length == 1)):
            move[j] = -np.linalg.solve(h[j], g[j]) if newton else memory[j].direction(g[j])
        trial = np.where(todo[:, None], w + length[:, None] * move, w)
        f2, g2, h2 = evaluate(trial)
        fine = todo & (f2 <= f + 1e-4 * length * (g * move).sum(axis=1) + 1e-12 * np.abs(f))
        for j in np.flatnonzero(fine):
            memory[j].learn(trial[j] - w[j], g2[j] - g[j])
            w[j], f[j], g[j] = trial[j], f2[j], g2[j]
            if newton:
                h[j] = h2[j]
        length = np.where(fine | ~todo, 1.0, length / 2)
        if (length < 1e-10).any():
            raise RuntimeError("no descent: the features may not be finite")
    return w


def fit_one_vs_rest(train: DataFrame, features: str, labels: str, n_classes: int,
                    c: float = LR_C, max_iter: int = LR_MAX_ITER, tol: float = 1e-6) -> OvrModel:
    """C2 + C3: balanced one-vs-rest logistic regression, all classes in one loop.

    ``labels`` is the multi-hot ``ARRAY<INT>`` column (P18).  A class without positives (or
    without negatives) gets a constant model.  ``tol`` bounds the gradient relative to
    ``c`` times the number of rows.
    """
    from subjex.operators.decode import MAX_CLASSES, bounded_collect

    ship_package(train.sparkSession)
    # read once an iteration: a written table, so that a lost executor costs no lineage
    data = written(train.select(F.col(features).cast("array<double>").alias("features"), F.col(labels).alias("y")), "training-rows")
    # every class's positives in one aggregate (classes rows, combined map-side)
    n = data.count()
    per_class = data.select(F.posexplode("y").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("pos"))
    pos = {r["j"]: int(r["pos"]) for r in bounded_collect(per_class, MAX_CLASSES, "classes")}
    positives = np.array([pos.get(j, 0) for j in range(n_classes)], np.float64)
    live = (positives > 0) & (positives < n)
    # A constant class has probability 0 (or 1) for every record
    intercepts = np.where(positives > 0, np.inf, -np.inf)
    first = data.first()
    dim = len(first["features"]) if first else 0
    coefficients = np.zeros((n_classes, dim))
    if live.any():
        weights = np.ones((n_classes, 2))  # A9; a constant class is left out of the loop below
        weights[live] = np.stack([n / (2 * (n - positives[live])), n / (2 * positives[live])], axis=1)
        newton = int(live.sum()) * (dim + 1) ** 2 <= MAX_HESSIAN
        prior = np.r_[np.ones(dim), 0.0]  # the intercept is not regularised

        def evaluate(w):
            full = np.zeros((n_classes, dim + 1))
            full[live] = w
            sums = summed(data.mapInArrow(_loss_sums(full, weights, newton), "chunk int, m binary"), 1).reshape(n_classes, -1)[live]
            value = c * sums[:, 0] + 0.5 * (prior * w * w).sum(axis=1)
            gradient = c * sums[:, 1:dim + 2] + prior * w
            curve = c * sums[:, dim + 2:].reshape(-1, dim + 1, dim + 1) + np.diag(prior) if newton else None
            return value, gradient, curve
        w = _minimise(evaluate, int(live.sum()), dim + 1, newton, max_iter, tol * c * n)
        coefficients[live], intercepts[live] = w[:, :-1], w[:, -1]
    return OvrModel(coefficients, intercepts, n_classes)


# ---------------------------------------------------------------------------
# C4: scoring

def predict_proba(df: DataFrame, features: str, model: OvrModel, out: str = "probs") -> DataFrame:
    """C4: ``ARRAY<DOUBLE>`` of class probabilities, all classes in one pass."""
    if model.coefficients.size > MAX_COEFFICIENTS:
        raise ValueError("coefficient matrix too large to ship with the scoring function")
    coef = model.coefficients.T.copy()
    inter = model.intercepts.copy()
    ship_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(vecs: pd.Series) -> pd.Series:
        x = np.vstack(vecs.to_numpy()).astype(np.float64)
        with np.errstate(over="ignore"):
            z = x @ coef + inter
            p = 1.0 / (1.0 + np.exp(-z))
        return pd.Series(list(p))

    return df.withColumn(out, score(F.col(features)))


def save_model(model: OvrModel, classes: DataFrame, path: str) -> None:
    """Coefficients as a table ``(class_idx, intercept, coefficients)`` next to
    the class table, written as Parquet."""
    spark = classes.sparkSession
    rows = [(j, float(model.intercepts[j]), [float(x) for x in model.coefficients[j]])
            for j in range(model.n_classes)]
    spark.createDataFrame(rows, "class_idx INT, intercept DOUBLE, coefficients ARRAY<DOUBLE>") \
        .write.mode("overwrite").parquet(f"{path}/coefficients")
    classes.write.mode("overwrite").parquet(f"{path}/classes")


def load_model(spark, path: str) -> tuple[OvrModel, DataFrame]:
    """S17 (read)."""
    from subjex.operators.decode import MAX_CLASSES, bounded_collect
    rows = sorted(bounded_collect(spark.read.parquet(f"{path}/coefficients"), MAX_CLASSES,
                                  "coefficients"), key=lambda r: r["class_idx"])
    coef = np.array([r["coefficients"] for r in rows])
    inter = np.array([r["intercept"] for r in rows])
    return OvrModel(coef, inter, len(rows)), spark.read.parquet(f"{path}/classes")


# ---------------------------------------------------------------------------
# C14: train -> thresholds -> dev score

@dataclass
class TrainResult:
    model: OvrModel
    thresholds: DataFrame  # (class_idx, threshold)
    dev_metrics: DataFrame  # (dev_f1_micro, dev_f1_macro)


def train_domains(train: DataFrame, dev: DataFrame, key: str, features: str, labels: str,
                  n_classes: int, c: float = LR_C, max_iter: int = LR_MAX_ITER) -> TrainResult:
    """C14: fit on ``train``, fit exact thresholds on ``dev`` probabilities, score dev."""
    from subjex.operators.decode import apply_thresholds, threshold_list
    from subjex.operators.metrics import align, confusion, micro_macro
    from subjex.operators.thresholds import fit_thresholds_exact, long_probs

    model = fit_one_vs_rest(train, features, labels, n_classes, c=c, max_iter=max_iter)
    dev_p = predict_proba(dev.select(key, features, labels), features, model)
    spark = dev.sparkSession
    classes = spark.range(n_classes).select(F.col("id").cast("int").alias("class_idx"))
    thr = fit_thresholds_exact(long_probs(dev_p, key, "probs", labels), classes)
    pred = dev_p.select(key, apply_thresholds("probs", threshold_list(thr)).alias("labels"))
    mm = micro_macro(confusion(align(pred, dev, key, gold_col=labels)))
    return TrainResult(model, thr, mm.select(F.col("micro_f1").alias("dev_f1_micro"),
                                             F.col("macro_f1").alias("dev_f1_macro")))
