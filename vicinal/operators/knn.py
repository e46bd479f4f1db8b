"""Nearest neighbours: exact in blocks, and approximate by random-projection leaves and local joins.

Points are rows (id, v); neighbour tables are (src, dst, d2, rk), ordered by distance and then by id.  A
point is never its own neighbour.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.vectors import LEAST_D2, sqdist
from vicinal.session import cut, drop

#: Points of one side of a block task, of which a task holds two: in small tables, and at most.
BLOCK, MOST_BLOCK = 512, 4096
#: Points that the trees are fitted to at most; every point is placed in every tree.
SAMPLE_POINTS = 20_000
#: Points of a leaf that one task compares; larger leaves are split further.
LEAF_POINTS = 4096
#: Points that a leaf of a tree is to have at least; a block of so many is compared as one product of matrices.
LEAST_LEAF = 256
#: Nearest neighbours of a vertex that take part in local joins, and reverse ones that one join takes; those
#: of a hub are dealt to several.
JOINED, REVERSE = 16, 32


def points(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src; of repeated pairs the nearer one counts.  Admits better candidates to a
    bounded list when united with an older table."""
    order = Window.partitionBy("src").orderBy("d2", "dst")
    least = candidates.where("src <> dst").groupBy("src", "dst").agg(F.min("d2").alias("d2"))
    return least.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def block_pairs(pts: DataFrame, kernel, schema: str, block: int | None = None, carry: str | None = None) -> DataFrame:
    """``kernel(left ids, left matrix, right ids, right matrix, right carry)`` on every ordered pair of blocks.

    Two blocks meet once, in a task that takes them both ways, so every point is sent once for each block.
    Without ``block`` it grows with the table up to MOST_BLOCK, which changes how much is sent and nothing else.
    """
    n = pts.count()
    block = block or min(MOST_BLOCK, max(BLOCK, n // 16))
    blocks = max(1, -(-n // block))
    extra = F.col(carry).cast("long").alias("c") if carry else F.lit(0).cast("long").alias("c")
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")
    rows = pts.select(own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "id", "v", extra)
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "id", "v", "c")

    def run(table: pa.Table) -> pa.Table:
        right = table["right"].to_numpy()
        sides = [(t["id"].to_numpy(), matrix(t["v"]), t["c"].to_numpy()) for t in (table.filter(pa.array(~right)), table.filter(pa.array(right)))]
        ways = [(0, 0)] if table["i"][0] == table["j"][0] else [(0, 1), (1, 0)]
        return pa.concat_tables([pa.table(kernel(*sides[x][:2], *sides[y])) for x, y in ways])

    return rows.groupBy("i", "j").applyInArrow(run, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of one point with many, from differences, so that near points keep their digits."""
    return np.maximum(((b - a) ** 2).sum(axis=1), LEAST_D2)


def closest(ids: np.ndarray | None, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, d2) of all that are as near as the k-th nearest, and maybe some more.  With ``ids``,
    no point is near itself."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for at in range(0, len(a) if len(others) else 0, 512):
        x = a[at : at + 512]
        d = products(x, b)
        if ids is not None:
            d[ids[at : at + 512, None] == others[None, :]] = np.inf
        # products lose digits, so all that may be as near are measured again
        loss = 1e-9 * ((b - b.mean(axis=0)) ** 2).sum(axis=1).max() + 1e-9 * ((x - b.mean(axis=0)) ** 2).sum(axis=1)[:, None]
        i, j = np.nonzero(d <= np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, [min(k, d.shape[1]) - 1]] + loss)
        keep = np.isfinite(d[i, j])
        i, j = i[keep], j[keep]
        for column, values in zip(out, (at + i, j, np.maximum(((b[j] - x[i]) ** 2).sum(axis=1), LEAST_D2)), strict=True):
            column.append(values)
    return tuple(map(np.concatenate, out))


def exact_knn(pts: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """The k nearest of every point, by all pairs in blocks; each block pair hands on k for each point."""

    def kernel(ids, a, others, b, _):
        i, j, d2 = closest(ids, a, others, b, k)
        return {"src": ids[i], "dst": others[j], "d2": d2}

    return top_k(block_pairs(pts, kernel, "src long, dst long, d2 double", block), k)


def pairwise(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Squared distances of all pairs, src < dst; a task gives block * block rows."""

    def kernel(ids, a, others, b, _):
        parts = [(others[keep], i, distances(x, b[keep])) for i, x in zip(ids, a, strict=True) if (keep := others > i).any()]
        return {
            "src": np.concatenate([np.full(len(o), i) for o, i, _ in parts]).astype(np.int64) if parts else np.empty(0, np.int64),
            "dst": np.concatenate([o for o, _, _ in parts]).astype(np.int64) if parts else np.empty(0, np.int64),
            "d2": np.concatenate([d for _, _, d in parts]) if parts else np.empty(0),
        }

    return block_pairs(pts, kernel, "src long, dst long, d2 double", block)


def nn_descent_pass(knn: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """One pass: neighbours of neighbours that aren't neighbours yet, with their distances, to the k best."""
    step = knn.select("src", "dst").join(knn.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst")
    fresh = step.select("src", F.col("far").alias("dst")).where("src <> dst").distinct().join(knn.select("src", "dst"), ["src", "dst"], "left_anti")
    a = pts.select(F.col("id").alias("src"), F.col("v").alias("va"))
    b = pts.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
    measured = fresh.join(a, "src").join(b, "dst").select("src", "dst", sqdist(F.col("va"), F.col("vb")).alias("d2"))
    return top_k(measured.unionByName(knn.select("src", "dst", "d2")), k)


class ProjectionTree:
    """Splits by sparse projections of +1 and -1 at the upper median of a sample."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int, depth: int = 20) -> None:
        self.rng = np.random.Generator(np.random.Philox(seed))
        self.nodes: list[tuple[np.ndarray, np.ndarray, float, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, depth)

    def _grow(self, x: np.ndarray, leaf: int, depth: int) -> int:
        if len(x) <= leaf or depth == 0:
            self.leaves += 1
            return -self.leaves
        dims = x.shape[1]
        at = self.rng.choice(dims, max(1, dims // 3), replace=False)
        sign = self.rng.choice([-1.0, 1.0], len(at))
        value = x[:, at] @ sign
        cut_at = float(np.sort(value)[len(value) // 2])
        low = value < cut_at
        if not low.any():
            self.leaves += 1
            return -self.leaves
        k = len(self.nodes)
        self.nodes.append((at, sign, cut_at, 0, 0))
        left, right = self._grow(x[low], leaf, depth - 1), self._grow(x[~low], leaf, depth - 1)
        self.nodes[k] = (at, sign, cut_at, left, right)
        return k

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.root, dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node
            elif len(rows):
                at, sign, cut_at, left, right = self.nodes[node]
                low = x[np.ix_(rows, at)] @ sign < cut_at
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def leaves(pts: DataFrame, trees: int = 4, leaf: int = 10, seed: int = 0) -> DataFrame:
    """(tree, leaf, id) of every point, in trees fitted to a bounded sample."""
    n = pts.count()
    bound = min((1 << 63) - 1, int(SAMPLE_POINTS / max(1, n) * (1 << 63)))
    sample = pts.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1) <= bound).select("id", "v").toPandas().sort_values("id")
    if n and not len(sample):
        raise ValueError(f"no point of {n} is in the sample that trees are fitted to")
    if not n:
        return pts.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"), "id")
    x = np.stack(sample["v"].to_list())
    forest = [ProjectionTree(x, leaf, seed + t) for t in range(trees)]

    def run(batches):
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column(1)]))
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), t, np.int32)), pa.array(tree.place(v) if len(v) else np.empty(0, np.int64)), batch.column(0)], names=["tree", "leaf", "id"]
                )

    return pts.select("id", "v").mapInArrow(run, "tree int, leaf long, id long")


def split_leaves(placed: DataFrame, pts: DataFrame, most: int = LEAF_POINTS, seed: int = 0) -> DataFrame:
    """``placed`` with leaves of over ``most`` points halved, by projections of their own points, until none is
    left.  A leaf whose points coincide stays whole."""
    done, step = None, 0
    join = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        sizes = cut(placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"), "sizes")
        if sizes.isEmpty():
            return join(done, placed)
        done = join(done, placed.join(sizes, ["tree", "leaf"], "left_anti"))
        large = placed.join(sizes, ["tree", "leaf"]).join(pts, "id").select("tree", "leaf", "id", "v")
        large = cut(large.mapInArrow(_projected(seed, step), "tree int, leaf long, id long, value double"), "projected")
        bounds = large.groupBy("tree", "leaf").agg(F.min("value").alias("least"), F.max("value").alias("top"), F.percentile_approx("value", 0.5).alias("half"))
        large = large.join(bounds, ["tree", "leaf"])
        # where half of the points or more have the least value, they part from the others
        low = (F.col("value") < F.col("half")) | (F.col("value") == F.col("least"))
        # leaves have numbers under 2 to the 20; each halving has a bit of its own
        parted = cut(large.select("tree", F.when(low, F.col("leaf")).otherwise(F.col("leaf") + (1 << 20 + step)).alias("leaf"), "id", (F.col("least") == F.col("top")).alias("whole")), "parted")
        done = done.unionByName(parted.where("whole").drop("whole"))
        placed, step = parted.where("not whole").drop("whole"), step + 1


def _projected(seed: int, step: int):
    def run(batches):
        for batch in batches:
            tree, leaf, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(pa.chunked_array([batch.column(3)]))
            value = np.empty(len(v))
            of, at = np.unique(np.stack([tree, leaf]), axis=1, return_inverse=True)
            order = np.argsort(at.ravel(), kind="stable")
            for (t, k), rows in zip(of.T.tolist(), np.split(order, np.cumsum(np.bincount(at.ravel()))[:-1]), strict=True):
                direction = np.random.default_rng([seed & 0xFFFFFFFF, step, t, k]).normal(size=v.shape[1])
                # row by row in one order, so that equal points have equal values
                value[rows] = (v[rows] * direction).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(value)], names=["tree", "leaf", "id", "value"])

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all with all by a product of matrices, about a common centre: to choose by, not to keep."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, rows: int = 512) -> dict[str, np.ndarray]:
    """src, dst and d2 of the k nearest of each row: a few more are chosen by products, then measured."""
    src, dst, d2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for at in range(0, len(ids) if len(others) else 0, rows):
        own, x = ids[at : at + rows], a[at : at + rows]
        d = products(x, b)
        d[own[:, None] == others[None, :]] = np.inf
        most = min(k + 8, len(others))
        best = np.argpartition(d, most - 1, axis=1)[:, :most]
        true = np.maximum(((b[best] - x[:, None, :]) ** 2).sum(axis=2), LEAST_D2)
        true[own[:, None] == others[best]] = np.inf
        order = np.lexsort((others[best], true), axis=1)[:, :k]
        true, best = np.take_along_axis(true, order, 1), np.take_along_axis(best, order, 1)
        keep = np.isfinite(true)
        src.append(np.broadcast_to(own[:, None], true.shape)[keep])
        dst.append(others[best][keep])
        d2.append(true[keep])
    return {"src": np.concatenate(src), "dst": np.concatenate(dst), "d2": np.concatenate(d2)}


def leaf_candidates(pts: DataFrame, placed: DataFrame, k: int, most: int = LEAF_POINTS) -> DataFrame:
    """The k nearest of each point among all its leaf-mates; leaves beyond ``most`` points are dealt out in
    parts, and each part is compared with every part."""
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    rows = placed.join(sizes, ["tree", "leaf"]).join(pts, "id")
    rows = rows.select("tree", "leaf", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("own"), F.sequence(F.lit(0), F.col("parts") - 1).alias("every"), "id", "v")
    left = rows.select("tree", "leaf", F.col("own").alias("i"), F.explode("every").alias("j"), F.lit(0).alias("side"), "id", "v")
    # within a part the left side is the right one too
    right = rows.where(F.size("every") > 1).select("tree", "leaf", F.explode("every").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "v").where("i <> j")

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        lefts = table.filter(pa.array(side == 0))
        rights = lefts if table["i"][0] == table["j"][0] else table.filter(pa.array(side == 1))
        return pa.table(nearest(lefts["id"].to_numpy(), matrix(lefts["v"]), rights["id"].to_numpy(), matrix(rights["v"]), k))

    return left.unionByName(right).groupBy("tree", "leaf", "i", "j").applyInArrow(run, "src long, dst long, d2 double")


def local_joins(knn: DataFrame, pts: DataFrame, k: int, joined: int = JOINED, most: int = REVERSE) -> DataFrame:
    """(src, dst, d2) of pairs that have a neighbour in common, as one of its ``joined`` nearest or of those of
    which it is one, and that would enter src's list, or are in it.

    Every vertex gathers the vectors of its neighbours and of up to ``most`` reverse ones, a hub in several
    parts (of which reverse neighbours in two parts don't meet), and compares them.  So a vector is sent once for each list that it stands in, not
    once for each pair.
    """
    near = knn.where(F.col("rk") <= joined)
    back = near.select(F.col("dst").alias("at"), F.col("src").alias("id"))
    parts = back.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    back = back.join(parts, "at").select("at", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id")
    ahead = near.select(F.col("src").alias("at"), F.col("dst").alias("id")).join(parts, "at", "left")
    ahead = ahead.select("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "id")
    last = knn.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("rk") == k, F.col("d2"))).alias("last"))
    known = pts.join(last, "id", "left").select("id", "v", F.coalesce("last", F.lit(float("inf"))).alias("last"))
    rows = back.unionByName(ahead).join(known, "id").select("at", "part", "id", "last", "v")
    return rows.repartition("at", "part").sortWithinPartitions("at", "part").mapInArrow(_joined, "src long, dst long, d2 double")


def _joined(batches):
    """Rows (at, part, id, last, v) in order of the first two."""

    def pairs(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, first = np.unique(group.column(2).to_numpy(), return_index=True)
        x, last = matrix(pa.chunked_array([group.column(4)]))[first], group.column(3).to_numpy()[first]
        near = products(x, x) <= last[:, None] * (1 + 1e-6) + 1e-9
        np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        d2 = np.maximum(((x[i] - x[j]) ** 2).sum(axis=1), LEAST_D2)
        keep = d2 <= last[i]
        return ids[i[keep]], ids[j[keep]], d2[keep]

    def table(found: list) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.float64)
        columns = [pa.array(np.concatenate([f[c] for f in found]) if found else np.empty(0, kinds[c])) for c in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "d2"])

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)) if batch.num_rows else np.zeros(1, int)
        found = [pairs(batch.slice(a, b - a)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        rest = batch.slice(starts[-1])  # its group may go on
        yield table(found)
    if rest is not None and rest.num_rows:
        yield table([pairs(rest)])


def approx_knn(
    pts: DataFrame, k: int, trees: int = 16, leaf: int | None = None, passes: int = 10, seed: int = 0, most: int = LEAF_POINTS, least_change: float = 0.002
) -> DataFrame:
    """Leaf-mates of several trees, refined by local joins until a pass changes less than a share of the lists.

    k must be less than the number of points.
    """
    pts = cut(pts, "points")
    n = pts.count()
    if k >= n:
        raise ValueError(f"k is {k}, of {n} points")
    placed = split_leaves(cut(leaves(pts, trees, leaf or max(LEAST_LEAF, 4 * k), seed), "leaves"), pts, most, seed)
    knn = cut(top_k(leaf_candidates(pts, placed, k), k), "knn")
    for _ in range(passes):
        found = knn.select("src", "dst", "d2", F.lit(0).alias("new")).unionByName(local_joins(knn, pts, k).withColumn("new", F.lit(1)))
        found = found.where("src <> dst").groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.min("new").alias("new"))
        order = Window.partitionBy("src").orderBy("d2", "dst")
        better = cut(found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k), "knn")
        changed = better.where("new = 1").count()
        drop(knn)
        knn = better
        if changed <= least_change * k * n:
            break
    return knn.select("src", "dst", "d2", "rk")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    hits = true.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
