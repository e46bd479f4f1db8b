"""The rank correlation of all distances in a layout with differences of a value, without a table of the pairs.

The distances, in steps of 1e-9, are cut into ranges of about as many pairs.  A task takes a range: a tree of the
points leads it to those cells between which such distances can lie, it measures them, sorts them, and sums
their ranks.  What a range needs of the others is only how many pairs lie below it, which is added at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vicinal.functions.vectors import LEAST_D2
from vicinal.operators.knn import matrix

#: Pairs of a range, about, where a pair takes 4 bytes (half as many where it takes 8); ranges found to have over
#: twice as many are cut further.  Smaller tables have up to RANGES of MANY pairs.
PAIRS, RANGES, MANY = 20_000_000, 24, 1 << 20
#: Points of a cell at most, pairs that are measured at once, and points between which the ranges are estimated.
CELL, AT_ONCE, SAMPLE = 32, 1 << 16, 2048
#: Different values up to which the ranks of their differences are kept as a table.
MOST_VALUES = 1024
#: Steps of distance in 1, and the least distance in steps.
STEPS = 1e9
LEAST = int(np.floor(np.sqrt(LEAST_D2) * STEPS + 0.5))


def steps(d2: np.ndarray) -> np.ndarray:
    """Distances rounded to steps."""
    return np.floor(np.sqrt(np.maximum(d2, LEAST_D2)) * STEPS + 0.5).astype(np.int64)


class Differences:
    """The absolute differences of all pairs of values: of two codes the difference's code, and its rank from the mean."""

    def __init__(self, values: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        known, code = np.unique(values[~null], return_inverse=True)
        self.code = np.full(len(values), len(known), np.int64)
        self.code[~null] = code
        self.m = len(known) + bool(null.any())
        # a pair that lacks a value ranks last
        apart = np.full((self.m, self.m), np.inf)
        apart[: len(known), : len(known)] = np.abs(known[:, None] - known[None, :])
        kinds, of = np.unique(apart, return_inverse=True)
        self.of = of.reshape(-1).astype(np.int32)
        n = np.bincount(self.code, minlength=self.m)
        pairs = n[:, None] * n[None, :]
        pairs[np.diag_indices(self.m)] = n * (n - 1)
        # rows of one id are no pairs
        order = np.argsort(ids, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(np.unique(ids)) < len(ids) else ():
            c = np.bincount(self.code[rows], minlength=self.m)
            own = c[:, None] * c[None, :]
            own[np.diag_indices(self.m)] = c * (c - 1)
            pairs -= own
        count = np.zeros(len(kinds), np.int64)
        np.add.at(count, self.of, pairs.reshape(-1))
        count //= 2
        self.n = int(count.sum())
        rank = np.cumsum(count) - count + (count + 1) / 2.0
        self.rank = rank - (self.n + 1) / 2.0
        self.squares = float((count * self.rank**2).sum())
        self.bits = max(1, int(len(kinds) - 1).bit_length())


class Cells:
    """Points in the leaves of a balanced tree, all leaves as long, with the boxes of all nodes."""

    def __init__(self, x: np.ndarray, code: np.ndarray, ids: np.ndarray, cell: int | None = None) -> None:
        n, dim = x.shape
        depth = max(0, int(np.ceil(np.log2(max(1, n) / (cell or CELL)))))
        parts = [np.arange(n)]
        for _ in range(depth):
            halves = []
            for rows in parts:
                axis = int(np.argmax(np.ptp(x[rows], axis=0)))
                order = rows[np.argsort(x[rows, axis], kind="stable")]
                halves += [order[: len(order) // 2], order[len(order) // 2 :]]
            parts = halves
        self.size = max(map(len, parts))
        self.x = np.full((dim, len(parts), self.size), np.nan)
        self.code, self.ids = (np.zeros((len(parts), self.size), np.int64) for _ in range(2))
        for k, rows in enumerate(parts):
            self.x[:, k, : len(rows)] = x[rows].T
            self.code[k, : len(rows)] = code[rows]
            self.ids[k, : len(rows)] = ids[rows]
        self.twins = len(np.unique(ids)) < n
        self.boxes = [(np.nanmin(self.x, axis=2), np.nanmax(self.x, axis=2))]
        for _ in range(depth):
            low, high = self.boxes[0]
            self.boxes.insert(0, (np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])))

    def between(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves, each once, that may have squared distances from ``low`` to ``high``."""
        a = b = np.zeros(1, np.int64)
        for level, (least, most) in enumerate(self.boxes):
            if level:
                a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
                once = a <= b
                a, b = a[once], b[once]
            near = far = 0.0
            for lo, hi in zip(least, most, strict=True):
                near = near + np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0.0) ** 2
                far = far + np.maximum(hi[a] - lo[b], hi[b] - lo[a]) ** 2
            keep = (near <= high) & (far >= low)
            a, b = a[keep], b[keep]
        return a, b

    def pairs(self, lo: int, hi: int, differences: Differences):
        """(steps, code of the difference) of the pairs with ``lo`` <= steps < ``hi``, many at a time."""
        # wider by what roots and rounding may lose; the steps decide
        low = -1.0 if lo <= LEAST else ((lo - 1) / STEPS * (1 - 1e-12)) ** 2
        high = ((hi + 1) / STEPS * (1 + 1e-12)) ** 2
        if hi <= LEAST:
            return
        a, b = self.between(low, high)
        size = self.size
        at_once = max(1, AT_ONCE // size**2)
        later = np.triu(np.ones((size, size), bool), 1)
        buffers = np.empty((2, at_once, size, size))
        for k in range(0, len(a), at_once):
            i, j = a[k : k + at_once], b[k : k + at_once]
            d2, square = buffers[0, : len(i)], buffers[1, : len(i)]
            for axis, x in enumerate(self.x):
                to = square if axis else d2
                np.subtract(x[i][:, :, None], x[j][:, None, :], out=to)
                np.multiply(to, to, out=to)
                if axis:
                    np.add(d2, square, out=d2)
            keep = (d2 >= low) & (d2 <= high)
            same = np.flatnonzero(i == j)
            keep[same] &= later
            if self.twins:
                keep &= self.ids[i][:, :, None] != self.ids[j][:, None, :]
            at = np.flatnonzero(keep)
            q = steps(d2.reshape(-1)[at])
            inside = (q >= lo) & (q < hi)
            if not inside.all():
                at, q = at[inside], q[inside]
            row = at // size
            of = self.code[j].reshape(-1)[row // size * size + (at - row * size)]
            yield q, differences.of[self.code[i].reshape(-1)[row] * differences.m + of]


def tied(sizes: np.ndarray) -> float:
    return float((sizes.astype(float) ** 3 - sizes).sum())


def sums(cells: Cells, differences: Differences, lo: int, hi: int, most: int) -> tuple[int, float, float, float]:
    """Of the pairs with ``lo`` <= steps < ``hi``: their number, the sum of their differences' ranks, the sum of
    those times their own rank in the range, and what ties take off the squares of ranks (c ** 3 - c)."""
    bits, rank = differences.bits, differences.rank
    if hi - lo == 1:  # all are tied
        n, s = 0, 0.0
        for _, t in cells.pairs(lo, hi, differences):
            n, s = n + len(t), s + float(rank[t].sum())
        return n, s, s * (n + 1) / 2.0, float(n) ** 3 - n
    kind = np.uint32 if (hi - lo) << bits <= 1 << 32 else np.uint64
    most = most if kind == np.uint32 else most // 2
    # what isn't written takes no memory
    keys, n = np.empty(2 * most, kind), 0
    for q, t in cells.pairs(lo, hi, differences):
        if n + len(q) > len(keys):
            del keys
            return _parted(cells, differences, lo, hi, most)
        keys[n : n + len(q)] = (q - lo).astype(kind) << kind(bits) | t.astype(kind)
        n += len(q)
    keys = keys[:n]
    keys.sort()
    total, product, ties, begin = 0.0, 0.0, 0.0, 0
    while begin < n:
        end = min(n, begin + (1 << 20))
        after = (int(keys[end - 1]) >> bits) + 1 << bits  # whole groups of equal distances
        end = n if after > np.iinfo(kind).max else int(np.searchsorted(keys, kind(after)))
        part = keys[begin:end]
        q, w = part >> kind(bits), rank[part & kind((1 << bits) - 1)]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.append(first, len(q)))
        own = np.add.reduceat(w, first)
        total += float(own.sum())
        product += float((own * (begin + first + (size + 1) / 2.0)).sum())
        ties += tied(size)
        begin = end
    return n, total, product, ties


def _parted(cells: Cells, differences: Differences, lo: int, hi: int, most: int) -> tuple[int, float, float, float]:
    """``sums`` of a range that holds too many, by parts of it in order."""
    width = -(-(hi - lo) // 4096)
    counts = np.zeros(-(-(hi - lo) // width), np.int64)
    for q, _ in cells.pairs(lo, hi, differences):
        counts += np.bincount((q - lo) // width, minlength=len(counts))
    parts, held = [0], 0
    for k, c in enumerate(counts.tolist()):
        if held and held + c > most:
            parts.append(k)
            held = 0
        held += c
    edges = [lo + k * width for k in parts] + [hi]
    return _added([sums(cells, differences, a, b, most) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _added(parts: list[tuple[int, float, float, float]]) -> tuple[int, float, float, float]:
    """The sums of ranges in order as one."""
    n, total, product, ties = 0, 0.0, 0.0, 0.0
    for m, t, p, c in parts:
        product += p + n * t
        n, total, ties = n + m, total + t, ties + c
    return n, total, product, ties


def ranges(x: np.ndarray, n: int, bits: int, most: int) -> np.ndarray:
    """Edges between ranges of about ``most`` pairs, from the distances of evenly spread points; what they are
    changes how much a task does and nothing else."""
    top = int(steps(((x.max(axis=0) - x.min(axis=0)) ** 2).sum())) + 2
    some = x[:: -(-len(x) // SAMPLE)]
    q = np.sort(np.concatenate([steps(((some[k + 1 :] - some[k]) ** 2).sum(axis=1)) for k in range(len(some))]))
    wide = -(-n // most)
    if len(q) and int(q[-1] - q[0]) // wide << bits > 1 << 32:
        wide *= 2
    wide = max(wide, min(RANGES, -(-n // MANY)))
    inner = q[np.arange(1, wide) * len(q) // wide] if len(q) else np.empty(0, np.int64)
    edges = np.unique(np.concatenate(([LEAST], inner, [top])))
    # a range's steps and codes are to fit 63 bits
    return np.unique(np.concatenate([np.append(np.arange(a, b, 1 << 62 - bits), b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]))


def correlation(layout: DataFrame, truth: DataFrame, most: int | None = None) -> tuple[float | None, int] | None:
    """The rank correlation of distances in ``layout(id, v)`` with differences of ``truth(id, value)`` over all
    pairs of ids, and how many those are.  None where there are more than MOST_VALUES different values, or
    where a number is no number or too large for steps of 64 bits."""
    few = truth.select("value").distinct().limit(MOST_VALUES + 1).count()
    if few > MOST_VALUES:
        return None
    table = layout.select("id", "v").join(truth.select("id", "value"), "id").toArrow()
    if table.num_rows < 2:
        return None, 0
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    ids, x = table["id"].to_numpy()[order], matrix(table["v"])[order]
    null = table["value"].is_null().to_numpy()[order]
    values = table["value"].fill_null(0).to_numpy()[order]
    # differences of whole numbers are taken as such
    values = values if values.dtype.kind == "f" else values.astype(np.int64)
    if not np.isfinite(x).all() or not np.isfinite(values).all() or np.sqrt((np.ptp(x, axis=0) ** 2).sum()) * STEPS >= 1 << 60:
        return None
    differences = Differences(values, null, ids)
    n = differences.n
    if not n:
        return None, 0
    cells = Cells(x, differences.code, ids)
    most = most or PAIRS
    edges = ranges(x[np.lexsort(x.T)], n, differences.bits, most)

    def run(batches):
        for batch in batches:
            rows = [(int(k), *sums(cells, differences, int(edges[k]), int(edges[k + 1]), most)) for k in batch["id"]]
            yield pd.DataFrame(rows, columns=["k", "n", "total", "product", "ties"])

    count = len(edges) - 1
    found = layout.sparkSession.range(0, count, 1, count).mapInPandas(run, "k long, n long, total double, product double, ties double").collect()
    met, _, product, ties = _added([tuple(r)[1:] for r in sorted(found)])
    if met != n:
        raise RuntimeError(f"{met} of {n} pairs were ranked")
    squares = (n**3 - n) / 12.0 - ties / 12.0
    bound = squares * differences.squares
    return (product / float(np.sqrt(bound)) if bound > 0 else None), n
