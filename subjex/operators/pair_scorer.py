"""A pair scorer by late interaction (E2, R1): the best match of each label term in the record.

Terms have vectors, the rows of a fitted ``LsaEncoder``'s projection.  A label term's match is
its highest cosine with any term of the record (1 for the same term, 0 at least); the score is
the mean match, weighted by the label terms' inverse document frequency.  Only the first R
candidates of a record are scored: all of a record together where the caller can (``many``), or
pair by pair in Arrow batches through ``predict_batch_udf``.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjex.functions.vectors import NORM_EPS
from subjex.operators.encoders import LsaEncoder

#: Pairs of one batch.
BATCH = 512


class LateInteraction:
    def __init__(self, encoder: LsaEncoder):
        self.idf = np.maximum(encoder.idf, 0.0)
        self.vectors = encoder.projection / np.maximum(np.linalg.norm(encoder.projection, axis=1, keepdims=True), NORM_EPS)

    def terms(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text's T9 tokens."""
        n = len(self.idf)
        return np.unique(np.array([_first_bits(t) % n for t in set((text or "").lower().split())], np.int64))

    def score(self, record: np.ndarray, label: np.ndarray) -> float:
        weight = self.idf[label]
        if not len(record) or not weight.sum():
            return 0.0
        best = np.maximum((self.vectors[label] @ self.vectors[record].T).max(axis=1), 0.0)
        best[np.isin(label, record)] = 1.0
        return float(weight @ best / weight.sum())

    def scores(self, records, labels) -> np.ndarray:
        """The score of each pair of texts; a text that repeats is split into terms once."""
        known: dict[str | None, np.ndarray] = {}

        def terms(text):
            if text not in known:
                known[text] = self.terms(text)
            return known[text]
        return np.array([self.score(terms(r), terms(t)) for r, t in zip(records, labels)], np.float64)

    def of_record(self, record: np.ndarray, labels: list[np.ndarray]) -> list[float]:
        """The scores of several labels of one record: one product for all their terms."""
        sizes = [len(t) for t in labels]
        terms = np.concatenate(labels) if labels else record[:0]
        if not len(record) or not len(terms):
            return [0.0] * len(labels)
        best = np.maximum((self.vectors[terms] @ self.vectors[record].T).max(axis=1), 0.0)
        best[np.isin(terms, record)] = 1.0
        ends = np.cumsum(sizes)
        weight = self.idf[terms]
        return [float(weight[e - n:e] @ best[e - n:e] / weight[e - n:e].sum()) if n and weight[e - n:e].sum() else 0.0
                for n, e in zip(sizes, ends)]

    def many(self, record: Column, labels: Column) -> Column:
        """The scores of an array of label texts, in its order: a record's text travels once."""
        model = self

        @F.arrow_udf("array<double>")
        def score(records: pa.Array, lists: pa.Array) -> pa.Array:
            terms = lru_cache(1 << 14)(model.terms)  # of labels
            out = [model.of_record(model.terms(r.as_py()), [terms(t) for t in own.as_py() or []])
                   for r, own in zip(records, lists)]
            return pa.array(out, pa.list_(pa.float64()))
        return score(record, labels)

    def __call__(self, record: Column, label: Column) -> Column:
        """The scorer of ``suggest_dense`` and ``suggest_hybrid``."""
        from pyspark.ml.functions import predict_batch_udf
        model = self

        def loader():
            return lambda records, labels: model.scores(records, labels)
        return predict_batch_udf(loader, return_type=T.DoubleType(), batch_size=BATCH, input_tensor_shapes=[[], []])(record, label)


@lru_cache(maxsize=200_000)
def _first_bits(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
