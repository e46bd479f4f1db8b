"""Exact nearest neighbours of points in few dimensions, such as layouts, by cells instead of all pairs.

A tree over a bounded sample cuts the plane (or space) into cells of about as many points.  Every point first
looks in its own cell; the k-th distance found there bounds its reach, and it looks again only in those cells
that lie within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators.knn import LEAF_POINTS, closest, exact_knn, matrix
from vicinal.session import cut

#: Points that the tree is fitted to at most, and the cells that it has at most; every point is placed.
SAMPLE, CELLS = 1 << 18, 4096
#: Points of the sample that a cell has at most where the sample is small.
CELL_POINTS = 512
#: Up to so many points all pairs are compared, with the same result: some blocks cost less than the jobs of a tree.
ALL_PAIRS = 20_000


class CellTree:
    """Halves a sample at the upper median of its widest dimension, down to ``leaf`` points and never below ``least``."""

    def __init__(self, sample: np.ndarray, leaf: int, least: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._grow(sample, leaf, least)

    def _grow(self, x: np.ndarray, leaf: int, least: int) -> int:
        for axis in np.argsort(-np.ptp(x, axis=0), kind="stable").tolist() if len(x) > leaf else ():
            bound = float(np.sort(x[:, axis])[len(x) // 2])
            low = x[:, axis] < bound
            if min(low.sum(), (~low).sum()) >= least:
                k = len(self.nodes)
                self.nodes.append((axis, bound, 0, 0))
                self.nodes[k] = (axis, bound, self._grow(x[low], leaf, least), self._grow(x[~low], leaf, least))
                return k
        self.cells += 1
        return -self.cells

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that ``reach`` leads to along each axis; with 0, each row's own cell."""
        rows, cells, todo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                cells.append(np.full(len(at), -node))
            elif len(at):
                axis, bound, left, right = self.nodes[node]
                value = x[at, axis]
                todo += [(left, at[value - reach[at] < bound]), (right, at[value + reach[at] >= bound])]
        return np.concatenate(rows), np.concatenate(cells)


def _placed(tree: CellTree, points: DataFrame) -> DataFrame:
    """``points(id, v, r)`` with their cell."""

    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(1)]))
            rows, cells = tree.reached(x, np.zeros(len(x)))
            own = np.empty(len(x), np.int64)
            own[rows] = cells
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], names=["cell", "id", "v", "r"])

    return points.select("id", "v", "r").mapInArrow(run, "cell long, id long, v array<double>, r int")


def _visits(tree: CellTree, points: DataFrame) -> DataFrame:
    """``points(cell, id, v, d2)`` to (cell, id, v) for each other cell within the distance."""

    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(2)]))
            # wider by what sums and roots may lose
            reach = np.sqrt(batch.column(3).to_numpy()) * (1 + 1e-9) + 1e-14 * (np.abs(x).max(axis=1) if len(x) else 0.0)
            rows, cells = tree.reached(x, reach)
            away = cells != batch.column(0).to_numpy()[rows]
            rows = pa.array(rows[away])
            yield pa.RecordBatch.from_arrays([pa.array(cells[away]), batch.column(1).take(rows), batch.column(2).take(rows)], names=["cell", "id", "v"])

    return points.select("cell", "id", "v", "d2").mapInArrow(run, "cell long, id long, v array<double>")


def _met(queries: DataFrame, members: DataFrame, k: int, most: int) -> DataFrame:
    """(src, dst, d2) of the k nearest members of each query's cell, itself included; cells of over ``most``
    rows are dealt out in parts, and each part of the one meets each of the other."""
    parts = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = parts(queries, "n").join(parts(members, "m"), "cell")  # a row for each cell, of which there are at most CELLS
    own = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = queries.join(sizes, "cell").select("cell", own("n").alias("i"), every("m").alias("j"), F.lit(False).alias("member"), "id", "v")
    right = members.join(sizes, "cell").select("cell", every("n").alias("i"), own("m").alias("j"), F.lit(True).alias("member"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy()
        (ids, a), (others, b) = [(t["id"].to_numpy(), matrix(t["v"])) for t in (table.filter(pa.array(~member)), table.filter(pa.array(member)))]
        i, j, d2 = closest(None, a, others, b, k)
        return pa.table({"src": ids[i], "dst": others[j], "d2": d2})

    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(run, "src long, dst long, d2 double")


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy("d2", "dst"))).where(F.col("rk") <= k)


def cell_knn(pts: DataFrame, k: int, leaf: int = CELL_POINTS, most: int = LEAF_POINTS) -> DataFrame:
    """(src, dst, d2, rk) as of ``exact_knn``, for points of two or three dimensions.

    Points that coincide are asked about once, and the k + 1 of least ids answer for all of them, so a place
    that holds most of the table is no large cell.  Beyond CELLS * ``leaf`` points the cells grow instead of
    their number.
    """
    pts = pts.select("id", "v")
    n = pts.count()
    if n <= ALL_PAIRS:
        return exact_knn(pts, k)
    bound = min((1 << 63) - 1, int(SAMPLE / n * (1 << 63)))
    sample = pts.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= bound).select("v").toArrow()
    if not sample.num_rows:
        raise ValueError(f"no point of {n} is in the sample that cells are fitted to")
    x = np.unique(matrix(sample["v"]), axis=0)
    tree = CellTree(x, max(leaf, -(-len(x) // CELLS)), k + 1)
    same = Window.partitionBy("v").orderBy("id")
    placed = cut(_placed(tree, pts.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)), "placed")
    places = placed.where("r = 1")
    home = cut(_first(_met(places, placed, k + 1, most), "src", k + 1).drop("rk"), "home")
    # a cell has k + 1 points of the sample at least, or is the only one
    reach = home.groupBy(F.col("src").alias("id")).agg(F.max("d2").alias("d2"))
    visits = cut(_visits(tree, places.join(reach, "id")), "visits")
    found = _first(home.unionByName(_met(visits, placed, k + 1, most)), "src", k + 1).select(F.col("src").alias("place"), "dst", "d2")
    rows = pts.join(places.select("v", F.col("id").alias("place")), "v").select(F.col("id").alias("src"), "place").join(found, "place")
    return _first(rows.where("src <> dst").select("src", "dst", "d2"), "src", k)
