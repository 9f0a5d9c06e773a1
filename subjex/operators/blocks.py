"""The best items of one block of queries against one block of items, over Arrow tables.

Workers load this module without pandas, and a block's queries stay in the Arrow batches that
they came in: what is added are the item matrix and ``Q_CHUNK`` query rows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from subjex.functions.vectors import NORM_EPS
from subjex.operators.ranking import RANK_DECIMALS

# Query rows of one product with an item block.
Q_CHUNK = 128
# Neighbouring items whose highest score stands for them in the first cut.
RUN = 32


def near_best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that may be among a row's ``k`` highest after rounding, by row:
    at least these reach the k-th highest of the maxima of ``RUN`` columns.  Infinite
    scores are left out; scores must not be NaN."""
    n = sims.shape[1]
    runs = n // RUN
    if runs > 2 * k:
        tops = sims[:, :runs * RUN].reshape(len(sims), runs, RUN).max(axis=2)
    else:
        tops = sims
    kth = np.partition(tops, tops.shape[1] - min(k, n), axis=1)[:, tops.shape[1] - min(k, n)]
    rows, cols = np.divmod(np.flatnonzero(sims >= (kth - 2 * 10.0 ** -RANK_DECIMALS)[:, None]), n)
    some = np.isfinite(sims[rows, cols])
    return rows[some], cols[some]


def _matrix(lists) -> np.ndarray:
    """The lists of a column as the rows of a matrix; without a copy where no value is null."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (size != size[0]).any() or size[0] < 0:
        raise ValueError("vectors must not be null and must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size[0])


def _unit(x: np.ndarray, normalize: bool) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS) if normalize else x


def top_k_tables(k: int, normalize: bool, qk: str, ik: str, book=None):
    """Best ``k`` items of one block per query, by (score, id): (qk, ik, score).  Queries have
    their vectors in ``_qv``, items in ``_iv``; with ``book`` the item column holds codes,
    decoded once per block."""
    def fn(q: pa.Table, it: pa.Table) -> pa.Table:
        ids = it.column(ik).combine_chunks()
        if q.num_rows == 0 or it.num_rows == 0:
            return pa.table({qk: q.column(qk).slice(0, 0), ik: ids.slice(0, 0), "score": pa.array([], pa.float64())})
        imat = _matrix(it.column("_iv"))
        if book is not None:
            imat = np.hstack([book.codebooks[j][imat[:, j]] for j in range(book.m)])
        else:
            imat = _unit(imat, normalize)
        id_rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first") \
            .to_numpy(zero_copy_only=False).astype(np.int64)
        kk = min(k, len(imat))
        finite = np.isfinite(imat).all()
        out_q, out_i, out_s = [], [], []
        for batch in (b.slice(s, Q_CHUNK) for b in q.to_batches() for s in range(0, b.num_rows, Q_CHUNK)):
            qmat = _unit(_matrix(batch.column("_qv")), normalize)
            sims = qmat @ imat.T
            if finite and np.isfinite(qmat).all():
                rows, cols = near_best(sims, kk)
            else:
                rounded = np.round(sims, RANK_DECIMALS)
                kth = -np.partition(-rounded, kk - 1, axis=1)[:, kk - 1]
                rows, cols = np.nonzero(rounded >= kth[:, None])
            scores = sims[rows, cols]
            # ties are cut here by id, so a block hands on k rows a query at most
            order = np.lexsort((id_rank[cols], -np.round(scores, RANK_DECIMALS), rows))
            rows, cols, scores = rows[order], cols[order], scores[order]
            first = np.searchsorted(rows, rows)
            kept = np.arange(len(rows)) - first < kk
            out_q.append(batch.column(qk).take(pa.array(rows[kept])))
            out_i.append(cols[kept])
            out_s.append(scores[kept])
        return pa.table({qk: pa.concat_arrays(out_q), ik: ids.take(pa.array(np.concatenate(out_i))),
                         "score": np.concatenate(out_s)})
    return fn
