"""Vector math on ``ARRAY<FLOAT|DOUBLE>`` columns with higher-order functions (M1-M3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normalisation floor of the encoders' L2 normalisation.
NORM_EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """M1: ``1 / (1 + exp(-x))`` in double precision."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x).cast("double")))


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v) -> Column:
    """M2: ``v / max(|v|, eps)``; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(sq_norm(v)), F.lit(NORM_EPS))
    return F.transform(_c(v), lambda x: x.cast("double") / norm)


def dot(a, b) -> Column:
    """M3: dot product in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """M3: cosine similarity; 0 when either vector is zero."""
    den = F.greatest(F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)), F.lit(NORM_EPS))
    return dot(a, b) / den
