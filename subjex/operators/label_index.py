"""A stored label index: texts, vectors, cells and residual codes.

Built once from a label table with vectors, written as Parquet tables, loaded by any later
job.  ``search`` follows a beam over the cell tree and scores the labels of the probed cells
exactly or, with a codebook, from their codes.  With every cell probed and no codebook the
result equals exact search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from subjex.operators.cells import BEAM, FIT_ROWS, CellIndex, CellTree, fit_cells, fit_residuals, fitting_rows, place_items, search
from subjex.operators.decode import bounded_collect
from subjex.operators.neighbors import PqCodebook
from subjex.session import written

# Fixed value: cells probed by default, the reference's search setting.
DEFAULT_NPROBE = 32
#: Labels of a block that are scored again with their vectors, per label asked for.
REFINE = 4
# Bound on the cells or codebook rows that reach the driver (parameters of the index).
MAX_ROWS = 1_000_000


@dataclass
class LabelIndex:
    labels: DataFrame              # (gnd_id, [label_text,] embedding, cell, codes)
    tree: CellTree
    book: PqCodebook | None = None

    def search(self, queries: DataFrame, key: str, vec: str, k: int, nprobe: int = DEFAULT_NPROBE) -> DataFrame:
        """``(key, gnd_id, score, rank)`` from the ``nprobe`` nearest cells of each query."""
        index = CellIndex(self.labels, self.tree, "gnd_id", "embedding", self.book)
        return search(queries, key, vec, index, k, nprobe, REFINE * k if self.book is not None else 0, max(BEAM, nprobe))

    def save(self, path: str) -> None:
        spark = self.labels.sparkSession
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        nodes = [(level, i, c.tolist()) for level, centers in enumerate(self.tree.levels) for i, c in enumerate(centers)]
        spark.createDataFrame(nodes, "level INT, node INT, centroid ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/cells")
        books = [] if self.book is None else [
            (j, i, v.tolist()) for j, book in enumerate(self.book.codebooks) for i, v in enumerate(book)]
        spark.createDataFrame(books, "part INT, code INT, centroid ARRAY<DOUBLE>").write.mode("overwrite").parquet(f"{path}/codebooks")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LabelIndex":
        nodes = sorted(bounded_collect(spark.read.parquet(f"{path}/cells"), MAX_ROWS, "cells"), key=lambda r: (r["level"], r["node"]))
        tree = CellTree([np.array([r["centroid"] for r in nodes if r["level"] == level])
                         for level in range(nodes[-1]["level"] + 1)])
        rows = bounded_collect(spark.read.parquet(f"{path}/codebooks"), MAX_ROWS, "codebook rows")
        book = None
        if rows:
            m = max(r["part"] for r in rows) + 1
            stacked = np.array([r["centroid"] for r in sorted(rows, key=lambda r: (r["part"], r["code"]))])
            book = PqCodebook(stacked.reshape(m, len(rows) // m, -1), m, stacked.shape[1])
        return LabelIndex(spark.read.parquet(f"{path}/labels"), tree, book)


def branches_for(n_cells: int) -> tuple[int, ...]:
    """One level up to 16 cells, else levels of nearly equal width that give at least ``n_cells``."""
    if n_cells <= 16:
        return (n_cells,)
    depth = 2 if n_cells <= 1024 else 3
    width = math.ceil(n_cells ** (1 / depth))
    return (*[width] * (depth - 1), -(-n_cells // width ** (depth - 1)))


def build_label_index(labels: DataFrame, n_cells: int, m: int = 0, ksub: int = 256, fit_rows: int = FIT_ROWS) -> LabelIndex:
    """Index ``labels`` (gnd_id, embedding and any other columns): cells of a k-means tree and,
    when ``m`` is given, ``m`` codes a label.  The fit takes at most about ``fit_rows`` rows a
    cell, every label is indexed; save and load the index to fit only once."""
    data = fitting_rows(labels, "embedding", fit_rows * n_cells)
    tree = fit_cells(data, branches_for(n_cells))
    book = fit_residuals(data, tree, m, ksub) if m else None
    return LabelIndex(written(place_items(labels, "embedding", tree, book), "label-index"), tree, book)
