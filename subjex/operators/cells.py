"""Hierarchical cells and residual product quantisation (V2 - V4).

``fit_cells`` grows a k-means tree level by level: all nodes of a level advance together, one
job over the (bounded, hash-chosen) fitting rows an iteration, and only sums and counts of
the level's centres leave the tasks.  An item, or a query, reaches its cells by a beam over
the tree, so thousands of cells cost a few dozen distances a row.

``fit_residuals`` quantises what a cell's centre leaves of a vector: ``m`` codes of one byte.
A query turns into one table of ``m x 256`` partial products.  The score of an item in cell c
is ``q.c`` plus the ``m`` table entries that its codes name, so no code is ever decoded; the
best ``refine`` of a block may be scored again with the stored vector.

``search`` packs neighbouring cells into blocks of at most ``ITEM_BLOCK`` items (a larger cell
is split over blocks of its own).  A query travels once to each block that holds one of its
cells, with the list of these cells, and meets it in a co-grouped join; a block hands on the
best ``k`` a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subjex.functions.vectors import NORM_EPS
from subjex.operators.neighbors import PqCodebook, _nearest, near_best, train_pq
from subjex.operators.ranking import RANK_DECIMALS, top_k
from subjex.session import ship_package, written

#: Fitting rows a cell; chosen by a hash, every item is indexed.
FIT_ROWS = 256
#: Nodes kept per level when an item is assigned, and at least when a query descends.
BEAM = 8
QUERY_BLOCK, ITEM_BLOCK, Q_CHUNK = 16384, 8192, 64
_SHARES = 1 << 20
#: Numbers that a task holds at a time when rows meet centres or are sent to blocks (32 MB).
WORK = 1 << 22


def _rows(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_EPS)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(matrix.ravel()))


@dataclass
class CellTree:
    """Centres per level; node ``i`` of a level has the children ``i * b .. i * b + b - 1``."""

    levels: list[np.ndarray]

    @property
    def n_cells(self) -> int:
        return len(self.levels[-1])

    @property
    def centers(self) -> np.ndarray:
        return self.levels[-1]

    def by_angle(self) -> "CellTree":
        """The same tree with unit centres: distances then rank by angle, as queries do."""
        return CellTree([_unit(c) for c in self.levels])

    def nearest(self, x: np.ndarray, n: int, beam: int = BEAM) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first; a level keeps as many nodes as
        lead to ``n`` cells, ``beam`` at least.  With every node kept this is exact.  Rows are
        taken in runs, so the work space does not depend on their number."""
        n = min(n, self.n_cells)
        wide, kept = 1, 1  # numbers a row
        for level, centers in enumerate(self.levels):
            nodes = kept * len(centers) // (len(self.levels[level - 1]) if level else 1)
            wide = max(wide, nodes * (centers.shape[1] if nodes < len(centers) else 1))
            kept = self._kept(level, n, beam)
        step = max(1, WORK // wide)
        if len(x) <= step:
            return self._nearest(x, n, beam)
        return np.concatenate([self._nearest(x[a:a + step], n, beam) for a in range(0, len(x), step)])

    def _kept(self, level: int, n: int, beam: int) -> int:
        centers = len(self.levels[level])
        return n if level == len(self.levels) - 1 else min(centers, max(beam, -(-2 * n * centers // self.n_cells)))

    def _nearest(self, x: np.ndarray, n: int, beam: int) -> np.ndarray:
        norm = (x * x).sum(axis=1)[:, None]
        nodes = np.zeros((len(x), 1), np.int64)
        for level, centers in enumerate(self.levels):
            b = len(centers) // (len(self.levels[level - 1]) if level else 1)
            nodes = (nodes[:, :, None] * b + np.arange(b)).reshape(len(x), -1)
            if nodes.shape[1] == len(centers):  # all nodes: one product
                nodes = np.broadcast_to(np.arange(len(centers)), nodes.shape)
                far = norm - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)
            else:
                own = centers[nodes]
                far = norm - 2 * np.einsum("nd,nkd->nk", x, own) + (own * own).sum(axis=2)
            # centres that equal each other are told apart by number
            far = np.round(far, RANK_DECIMALS)
            order = np.lexsort((nodes, far), axis=1)[:, :self._kept(level, n, beam)]
            nodes = np.take_along_axis(nodes, order, axis=1)
        return nodes


def _children(tree: CellTree, centers: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The nearest of its node's children for each row."""
    if not tree.levels:
        return _nearest(x, centers)
    node = tree.nearest(x, 1)[:, 0]
    b = len(centers) // tree.n_cells
    out = np.empty(len(x), np.int64)
    for i in np.unique(node):
        mine = np.flatnonzero(node == i)
        out[mine] = i * b + _nearest(x[mine], centers[i * b:(i + 1) * b])
    return out


def _level_sums(tree: CellTree, centers: np.ndarray):
    def run(batches):
        total, count = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                child = _children(tree, centers, x)
                np.add.at(total, child, x)
                count += np.bincount(child, minlength=len(centers))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), _lists(total[used])], ["c", "n", "s"])
    return run


def _start(tree: CellTree, data: DataFrame, b: int, dim: int) -> np.ndarray:
    """Starting centres of a level: ``b`` rows of each node, the smallest by hash; a node with
    fewer rows repeats its own centre."""
    parents = tree.n_cells if tree.levels else 1

    def place(batches):
        for batch in batches:
            x = _rows(batch.column(0))
            node = tree.nearest(x, 1)[:, 0] if tree.levels and len(x) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0)], ["node", "v"])
    placed = data.mapInArrow(place, "node long, v array<double>").withColumn("h", F.xxhash64("v"))
    first = top_k(placed.withColumn("h", -F.col("h").cast("double")), "node", "v", "h", b)
    out = np.repeat(tree.centers, b, axis=0) if tree.levels else np.zeros((b, dim))
    for r in first.collect():  # bounded: centres of the level
        out[r["node"] * b + r["rank"] - 1] = r["v"]
    return out


def fitting_rows(items: DataFrame, vec: str, rows: int) -> DataFrame:
    """(v array<double>): about ``rows`` normalised vectors, the smallest by a hash; all of a
    smaller table.  A written table."""
    from subjex.functions.vectors import l2_normalize
    data = items.select(l2_normalize(vec).alias("v")).where(F.size("v") > 0)
    total = data.count()
    if total > rows:
        data = data.where(F.pmod(F.xxhash64("v"), F.lit(_SHARES)) < math.ceil(rows / total * _SHARES))
    return written(data, "fitting-vectors")


def fit_cells(data: DataFrame, branches: tuple[int, ...], max_iter: int = 8, tol: float = 1e-4) -> CellTree:
    """V2: the k-means tree with ``branches[l]`` children a node on level l, over the rows of
    ``data`` (v array<double>)."""
    first = data.first()
    if first is None:
        raise ValueError("no vectors to fit cells on")
    ship_package(data.sparkSession)
    tree = CellTree([])
    for b in branches:
        centers = _start(tree, data, b, len(first["v"]))
        for _ in range(max_iter):
            parts = data.mapInArrow(_level_sums(tree, centers), "c long, n long, s array<double>")
            sums = parts.select("c", "n", F.posexplode("s").alias("p", "x")).groupBy("c", "p").agg(
                F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()  # centres x dimensions numbers
            moved = centers.copy()
            at = sums.column("c").to_numpy(), sums.column("p").to_numpy()
            moved[at] = sums.column("x").to_numpy() / sums.column("n").to_numpy()
            step, centers = np.abs(moved - centers).max(), moved
            if step <= tol:
                break
        tree = CellTree([*tree.levels, centers])
    return tree


def fit_residuals(data: DataFrame, tree: CellTree, m: int, ksub: int = 256, max_iter: int = 8) -> PqCodebook:
    """V4: codebooks of the residuals (vector minus its cell's centre) of ``data`` (v)."""
    if ksub > 256:
        raise ValueError("a code is one byte: at most 256 centres a sub-vector")

    def residual(batches):
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                yield pa.RecordBatch.from_arrays([_lists(x - tree.centers[tree.nearest(x, 1)[:, 0]])], ["r"])
    return train_pq(written(data.mapInArrow(residual, "r array<double>"), "residuals"), "r", m, ksub,
                    max_iter=max_iter, normalize=False)


@dataclass
class CellIndex:
    """Items with their cells (and codes): ``items`` holds key, vector, ``cell``, ``codes``."""

    items: DataFrame
    tree: CellTree
    key: str
    vec: str
    book: PqCodebook | None = None
    counts: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.counts is None:  # one row a cell
            self.counts = np.zeros(self.tree.n_cells, np.int64)
            for r in self.items.groupBy("cell").agg(F.count("*").alias("n")).collect():
                self.counts[r["cell"]] = r["n"]


def place_items(items: DataFrame, vec: str, tree: CellTree, book: PqCodebook | None = None) -> DataFrame:
    """``items`` with ``cell int`` and, given a codebook, ``codes binary`` (one byte a part).
    Every row is placed; other columns travel along."""
    ship_package(items.sparkSession)

    @F.pandas_udf("cell int, codes binary")
    def place(vecs):
        import pandas as pd
        x = _unit(np.vstack(vecs.to_numpy()).astype(np.float64))
        cell = tree.nearest(x, 1)[:, 0]
        codes = [None] * len(x)
        if book is not None:
            left = x - tree.centers[cell]
            coded = np.stack([_nearest(left[:, j * book.dsub:(j + 1) * book.dsub], book.codebooks[j])
                              for j in range(book.m)], axis=1).astype(np.uint8)
            codes = [c.tobytes() for c in coded]
        return pd.DataFrame({"cell": cell.astype(np.int32), "codes": codes})
    placed = items.withColumn("_placed", place(F.col(vec)))
    return placed.withColumns({"cell": F.col("_placed.cell"), "codes": F.col("_placed.codes")}).drop("_placed")


def build_cells(items: DataFrame, key: str, vec: str, branches: tuple[int, ...], m: int = 0, ksub: int = 256,
                fit_rows: int = FIT_ROWS) -> CellIndex:
    """V2 (+ V4): tree and codebooks fitted on a bounded sample, every item placed and written."""
    data = fitting_rows(items, vec, fit_rows * math.prod(branches))
    tree = fit_cells(data, branches)
    book = fit_residuals(data, tree, m, ksub) if m else None
    return CellIndex(written(place_items(items, vec, tree, book), "cell-index"), tree, key, vec, book)


def block_plan(counts: np.ndarray, item_block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours share a block while they fit."""
    first, blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block, room, open_ = 0, item_block, False
    for c, n in enumerate(counts):
        if n > item_block:
            blocks[c] = -(-n // item_block)
            first[c] = block + open_
            block, room, open_ = first[c] + blocks[c], item_block, False
        else:
            if n > room:
                block, room = block + 1, item_block
            first[c], room, open_ = block, room - n, True
    return first, blocks


def _spread_queries(tree: CellTree, nprobe: int, first: np.ndarray, blocks: np.ndarray, counts: np.ndarray, beam: int):
    """Each query once per block that holds probed items, with the probed cells of that block.
    A query's copies grow with the blocks, so only some queries are spread at a time."""
    pairs = int(np.sort(blocks)[-nprobe:].sum())  # (query, cell, block) of one query at most
    copies = min(pairs, int((first + blocks).max()))

    def run(batches):
        for batch in (b.slice(a, step) for b in batches for step in [steps(b)] for a in range(0, b.num_rows, step)):
            x = _unit(_rows(batch.column("_qv")))
            cells = tree.nearest(x, nprobe, beam)
            row = np.repeat(np.arange(len(x)), cells.shape[1])
            cell = cells.ravel()
            some = counts[cell] > 0
            row, cell = row[some], cell[some]
            times = blocks[cell]
            row, own = np.repeat(row, times), np.repeat(cell, times)
            block = np.repeat(first[cell], times) + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            order = np.lexsort((own, block, row))
            row, own, block = row[order], own[order], block[order]
            fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else row
            ends = np.r_[fresh, len(row)].astype(np.int32)
            at = pa.array(row[fresh])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), _lists(x[row[fresh]]), pa.array(block[fresh].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(own.astype(np.int32)))],
                [batch.schema.names[0], "_qv", "_block", "_cells"])

    def steps(batch) -> int:
        dim = len(batch.column("_qv")[0]) if batch.num_rows else 0
        return max(1, WORK // max(1, copies * dim + 8 * pairs))
    return run


def block_scores(q: np.ndarray, probed: np.ndarray, cell: np.ndarray, vectors: np.ndarray, codes: np.ndarray | None,
                 tree: CellTree, book: PqCodebook | None) -> np.ndarray:
    """Scores (items x queries) of the items in probed cells, -inf for the others.  ``cell`` is
    sorted; ``probed``: queries x cells present.  With codes, scores are table sums."""
    out = np.full((len(cell), len(q)), -np.inf, np.float32 if book is not None else np.float64)
    present, start = np.unique(cell, return_index=True)
    ends = np.r_[start[1:], len(cell)]
    if book is not None:
        d = book.dsub
        tables = [(book.codebooks[j] @ q[:, j * d:(j + 1) * d].T).astype(np.float32) for j in range(book.m)]
        base = (tree.centers[present] @ q.T).astype(np.float32)
    for i, (a, b) in enumerate(zip(start, ends)):
        some = np.flatnonzero(probed[:, i])
        if not len(some):
            continue
        if book is None:
            if len(some) == len(q):
                np.matmul(vectors[a:b], q.T, out=out[a:b])
            else:
                out[a:b, some] = vectors[a:b] @ q[some].T
            continue
        total = np.repeat(base[i:i + 1], b - a, axis=0)
        for j in range(book.m):
            total += tables[j][codes[a:b, j]]
        out[a:b, some] = total[:, some]
    return out


def _search_block(index_tree: CellTree, book: PqCodebook | None, k: int, refine: int, qk: str, ik: str, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by([("cell", "ascending"), (ik, "ascending")])
        cell = right.column("cell").to_numpy()
        present, inverse = np.unique(cell, return_inverse=True)
        vectors = _unit(_rows(right.column("_iv")))
        finite = np.isfinite(vectors).all()
        by_id = right.column(ik).combine_chunks()
        id_rank = np.empty(len(cell), np.int64)
        id_rank[pc.array_sort_indices(by_id).to_numpy()] = np.arange(len(cell))
        codes = None
        if book is not None:
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(cell), book.m)
        lists = left.column("_cells").combine_chunks()
        first_cell = lists.values.to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
        left = left.take(pa.array(np.argsort(first_cell, kind="stable")))  # neighbours probe alike
        rows_q, rows_i, scores = [], [], []
        for s in range(0, left.num_rows, Q_CHUNK):
            part = left.slice(s, Q_CHUNK)
            q = _rows(part.column("_qv"))
            own = part.column("_cells").combine_chunks()
            probed = np.zeros((len(q), len(present)), bool)
            flat = own.flatten().to_numpy()
            at = np.minimum(np.searchsorted(present, flat), len(present) - 1)
            hit = present[at] == flat
            probed[np.repeat(np.arange(len(q)), own.value_lengths().to_numpy())[hit], at[hit]] = True
            found = block_scores(q, probed, cell, vectors, codes, index_tree, book)
            wide = min(len(cell), max(refine, k) if book is not None and refine else k)
            if book is None and finite and np.isfinite(q).all():
                by_query = np.ascontiguousarray(found.T)
                row, some = near_best(by_query, k)
                exact = by_query[row, some]
                order = np.lexsort((id_rank[some], -np.round(exact, RANK_DECIMALS), row))
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                rows_q.append(s + row[order])
                rows_i.append(some[order])
                scores.append(exact[order])
                continue
            for c in range(len(q)):
                col = found[:, c]
                if book is not None and refine:
                    some = np.argpartition(-col, wide - 1)[:wide]
                    some = some[np.isfinite(col[some])]
                    exact = vectors[some] @ q[c]
                else:
                    kth = np.partition(col, len(col) - wide)[len(col) - wide]
                    some = np.flatnonzero((np.round(col, RANK_DECIMALS) >= np.round(kth, RANK_DECIMALS)) & np.isfinite(col))
                    exact = col[some].astype(np.float64)
                best = np.lexsort((id_rank[some], -np.round(exact, RANK_DECIMALS)))[:k]
                rows_q.append(np.full(len(best), s + c))
                rows_i.append(some[best])
                scores.append(exact[best])
        return pa.table([left.column(qk).take(pa.array(np.concatenate(rows_q))),
                         right.column(ik).take(pa.array(np.concatenate(rows_i))),
                         pa.array(np.concatenate(scores))], schema=schema)
    return run


def search(queries: DataFrame, q_key: str, q_vec: str, index: CellIndex, k: int, nprobe: int, refine: int = 0,
           beam: int = BEAM, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK, rank_col: str = "rank") -> DataFrame:
    """V3 / V4: ``(q_key, key, score, rank)``, the best ``k`` items of the ``nprobe`` nearest cells.

    Without codes, cosines are exact (all cells probed: equal to ``exact_top_k``).  With codes,
    items are ranked by their table sums; ``refine`` > 0 scores the best ``refine`` of each block
    again with the stored vector.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    if q_key == index.key:
        raise ValueError("query and item keys need different names")
    ship_package(queries.sparkSession)
    first, blocks = block_plan(index.counts, item_block)
    key = queries.schema[q_key].dataType.simpleString()
    q = queries.select(q_key, F.col(q_vec).alias("_qv"))
    n_qb = max(1, -(-q.count() // query_block))
    qs = q.mapInArrow(_spread_queries(index.tree.by_angle(), nprobe, first, blocks, index.counts, beam),
                      f"`{q_key}` {key}, _qv array<double>, _block int, _cells array<int>") \
        .withColumn("_qb", F.pmod(F.xxhash64(q_key), F.lit(n_qb)).cast("int"))
    # the block of each cell: one row a cell
    plan = queries.sparkSession.createDataFrame(
        [(c, int(first[c]), int(blocks[c])) for c in range(len(first))], "cell int, _first int, _n int")
    own = F.pmod(F.xxhash64(F.col(index.key), F.lit(1)), F.col("_n")).cast("int")
    its = index.items.select(index.key, F.col(index.vec).alias("_iv"), "cell", "codes").join(F.broadcast(plan), "cell") \
        .select(index.key, "_iv", "cell", "codes", (F.col("_first") + own).alias("_block"),
                F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("_qb"))
    out = T.StructType([queries.schema[q_key], index.items.schema[index.key], T.StructField("score", T.DoubleType())])
    fn = _search_block(index.tree, index.book, k, refine, q_key, index.key, to_arrow_schema(out))
    best = qs.groupBy("_block", "_qb").cogroup(its.groupBy("_block", "_qb")).applyInArrow(fn, out)
    return top_k(best, q_key, index.key, "score", k, rank_col=rank_col)


def scored_share(queries: DataFrame, q_vec: str, index: CellIndex, nprobe: int, beam: int = BEAM) -> float:
    """Share of all (query, item) pairs that ``search`` scores."""
    tree, counts = index.tree.by_angle(), index.counts

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = counts[tree.nearest(_unit(_rows(batch.column(0))), nprobe, beam)].sum()
                yield pa.RecordBatch.from_arrays([pa.array([int(n)]), pa.array([batch.num_rows])], ["pairs", "rows"])
    r = queries.select(q_vec).mapInArrow(run, "pairs long, rows long").agg(F.sum("pairs"), F.sum("rows")).first()
    return r[0] / (r[1] * int(counts.sum()))
