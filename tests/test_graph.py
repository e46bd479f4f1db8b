"""Edge lists, gradients, neighbours and probabilities on small known inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import draws
from vicinal.functions import vectors as fx
from vicinal.operators import cells, coarsen, graph, knn, probability, sampling


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


def ids(spark, n):
    return spark.range(n)


TRIANGLE = [(0, 1, 0.5), (0, 2, 0.5), (1, 0, 0.5), (1, 2, 0.5), (2, 0, 0.5), (2, 1, 0.5)]


def test_triangle(spark):
    e = edges_of(spark, TRIANGLE)
    assert {r["degree"] for r in graph.degrees(ids(spark, 3), e).collect()} == {2}
    assert graph.validate(ids(spark, 3), e).first()["valid"]
    assert graph.is_symmetric(e).first()["symmetric"]
    assert [r["dst"] for r in graph.neighbours(e, 0).collect()] == [1, 2]
    asked = spark.createDataFrame([(0, 1), (0, 0)], "src long, dst long")
    assert {(r["dst"], r["w"], r["has_edge"]) for r in graph.weights(asked, e).collect()} == {(1, 0.5, True), (0, 0.0, False)}


def test_asymmetric_and_invalid(spark):
    e = edges_of(spark, TRIANGLE[:-1])
    assert not graph.is_symmetric(e).first()["symmetric"]
    cdf = {r["id"]: r["hi"] - r["lo"] for r in sampling.degree_cdf(graph.degrees(ids(spark, 3), e)).collect()}
    assert cdf[0] == pytest.approx(0.4) and cdf[1] == pytest.approx(0.4) and cdf[2] == pytest.approx(0.2)
    assert not graph.validate(ids(spark, 3), edges_of(spark, [(0, 9, 1)])).first()["valid"]
    assert not graph.validate(ids(spark, 3), edges_of(spark, [(0, 1, 1), (0, 1, 1)])).first()["valid"]
    assert not graph.validate(ids(spark, 0), edges_of(spark, [])).first()["valid"]
    assert graph.validate(ids(spark, 1), edges_of(spark, [])).first()["valid"]


def test_isolated_vertex_survives(spark):
    e = edges_of(spark, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 2, 1)])
    assert {r["id"]: r["degree"] for r in graph.degrees(ids(spark, 5), e).collect()}[4] == 0
    groups = coarsen.greedy_groups(ids(spark, 5), e)
    assert groups.count() == 5


def test_gradients(spark):
    one = spark.range(1)
    zero, right, up = [F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]
    row = one.select(*fx.grad_pos(zero, right, F.lit(1.0)), *fx.grad_neg(zero, up, F.lit(1.0), 1.0)).first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(0.0)
    assert row[2] == pytest.approx(0.0) and row[3] == pytest.approx(-1.0)
    assert one.select(*fx.grad_neg(zero, zero, F.lit(1.0), 7.0)).first()[0] == 0.0
    d = one.select(fx.sqdist(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("d")).first()["d"]
    assert d == pytest.approx(14.0) and 1 / (1 + d) == pytest.approx(1 / 15)


@pytest.mark.parametrize("term", ["pos", "neg"])
def test_gradients_are_those_of_the_objective(spark, term):
    rng = np.random.default_rng(3)
    a, b, h, p, gamma = rng.normal(size=2), rng.normal(size=2), 1e-6, 0.3, 7.0

    def value(y):
        d2 = ((y - b) ** 2).sum()
        return p * math.log(1 / (1 + d2)) if term == "pos" else gamma * p * math.log(1 - 1 / (1 + d2))

    ya, yb = [F.lit(float(x)) for x in a], [F.lit(float(x)) for x in b]
    g = fx.grad_pos(ya, yb, F.lit(p)) if term == "pos" else fx.grad_neg(ya, yb, F.lit(p), gamma)
    row = spark.range(1).select(*g).first()
    for k in range(2):
        step = np.eye(2)[k] * h
        assert row[k] == pytest.approx((value(a + step) - value(a - step)) / (2 * h), rel=1e-4)


def line(spark, n=20):
    return spark.createDataFrame([(i, [i + 0.1 * d for d in range(5)]) for i in range(n)], "id long, v array<double>")


def test_line_neighbours_and_probabilities(spark):
    found = knn.exact_knn(line(spark), 5, block=7)
    rows = {}
    for r in found.orderBy("src", "rk").collect():
        rows.setdefault(r["src"], []).append(r["dst"])
        assert r["d2"] == pytest.approx(5 * (r["src"] - r["dst"]) ** 2)
    assert rows[0] == [1, 2, 3, 4, 5]
    assert sorted(rows[10][:2]) == [9, 11] and len(rows[10]) == 5
    sym = graph.symmetrize(found)
    p = probability.pij(sym.select("src", "dst", "d2"), 20, 10.0)
    assert p.agg(F.sum("w")).first()[0] == pytest.approx(1.0, abs=1e-6)
    # a target above the degree runs into the bound
    assert probability.sigmas(sym.where("src = 0"), 50.0).first()["sigma"] > 999


def test_coincident_points(spark):
    rows = [(i, [1.0, 1.0] if i < 5 else [float(i), 0.0]) for i in range(10)]
    pts = spark.createDataFrame(rows, "id long, v array<double>")
    found = knn.exact_knn(pts, 4, block=3)
    own = [r["dst"] for r in found.where("src = 0").orderBy("rk").collect()]
    assert own == [1, 2, 3, 4]
    assert found.where("src = dst").isEmpty()
    assert found.where("src = 0").first()["d2"] == 1e-12


def test_descent_and_trees_find_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (40, 8)) for c in rng.normal(0, 3, (6, 8))])[rng.permutation(240)]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = knn.approx_knn(pts, 10, passes=2)
    assert knn.recall(found, knn.exact_knn(pts, 10)).first()["recall"] >= 0.9
    with pytest.raises(ValueError):
        knn.approx_knn(pts, 240)


def test_large_leaves_are_compared_as_a_whole(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (40, 8)) for c in rng.normal(0, 3, (6, 8))])[rng.permutation(240)]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    one_leaf = pts.select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("leaf"), "id")
    true = knn.exact_knn(pts, 10).cache()
    # no tree and no descent: all pairs of a leaf in parts of 30
    assert knn.recall(knn.top_k(knn.leaf_candidates(pts, one_leaf, 10, most=30), 10), true).first()["recall"] == 1.0
    split = knn.split_leaves(one_leaf, pts, most=30).cache()
    assert split.count() == 240 and split.select("id").distinct().count() == 240
    assert split.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 30
    eight = one_leaf.drop("tree").crossJoin(spark.range(8).select(F.col("id").cast("int").alias("tree"))).select("tree", "leaf", "id")
    found = knn.top_k(knn.leaf_candidates(pts, knn.split_leaves(eight, pts, most=30), 10, most=30), 10)
    assert knn.recall(found, true).first()["recall"] >= 0.8


def test_coincident_leaves_end(spark):
    pts = spark.createDataFrame([(i, [0.1, 0.7, 0.3] if i % 4 else [float(i), 0.0, 1.0]) for i in range(80)], "id long, v array<double>")
    one_leaf = pts.select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("leaf"), "id")
    sizes = sorted(r["count"] for r in knn.split_leaves(one_leaf, pts, most=8).groupBy("leaf").count().collect())
    assert sizes[-1] == 60 and sum(sizes) == 80 and sizes[-2] <= 8
    found = knn.approx_knn(pts, 3, trees=2, leaf=100, passes=0, most=8)
    assert found.where("src % 4 <> 0").groupBy("src").count().where("count = 3").count() == 60


def brute_groups(ids, edges, pull, seed):
    """Rounds of offers by plain loops."""
    group, step = {}, 0
    while len(group) < len(ids):
        free = [v for v in ids if v not in group]
        near = {v: sorted(((-w, b) for a, b, w in edges if a == v and b in free)) for v in free}
        seeds = {v for v in free if near[v] and draws.uniform(seed, step, v)[0] < 1 / (pull + 1)}
        asked = {}
        for v in free:
            if not near[v]:
                group[v] = v
            elif v not in seeds and (best := next(((w, b) for w, b in near[v] if b in seeds), None)):
                asked.setdefault(best[1], []).append((best[0], v))
        for s, own in asked.items():
            for _, v in [(0, s), *sorted(own)[:pull]]:
                group[v] = s
        step += 1
    return group


@pytest.mark.parametrize("most", [0, coarsen.LOCAL_EDGES])
def test_groups_like_brute_force(spark, monkeypatch, most):
    """The same in one task and over all executors; a group is a seed with some of its neighbours."""
    monkeypatch.setattr(coarsen, "LOCAL_EDGES", most)
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (110, 2)) if a != b}
    weight = {frozenset(p): float(rng.integers(1, 5)) for p in pairs}
    rows = sorted({(a, b, weight[frozenset((a, b))]) for x, y in pairs for a, b in ((x, y), (y, x))})
    for pull, seed in ((3, 5), (1, 6)):
        found = {r["id"]: r["gid"] for r in coarsen.greedy_groups(ids(spark, 62), edges_of(spark, rows), pull, seed).collect()}
        assert found == brute_groups(range(62), rows, pull, seed)
        linked = {(a, b) for a, b, _ in rows}
        assert all(v == g or (v, g) in linked for v, g in found.items())
        assert max(list(found.values()).count(g) for g in found.values()) <= pull + 1
    assert coarsen.greedy_groups(ids(spark, 0), edges_of(spark, [])).count() == 0


def test_coarse_edges_of_a_cycle(spark):
    ring = [(i, (i + s) % 8, 1.0 + min(i, (i + s) % 8)) for i in range(8) for s in (1, 7)]
    e = edges_of(spark, ring)
    found = coarsen.greedy_groups(ids(spark, 8), e, 3, 5).toPandas()
    assert sorted(found["id"]) == list(range(8)) and found.groupby("gid").size().max() <= 3
    of = dict(zip(found["id"], found["gid"], strict=True))
    want = {}
    for a, b, w in ring:
        if of[a] != of[b]:
            want[of[a], of[b]] = max(w, want.get((of[a], of[b]), 0))
    assert {(r["src"], r["dst"]): r["w"] for r in coarsen.coarse_edges(e, spark.createDataFrame(found)).collect()} == want


def test_draws_are_the_same_in_plans_and_kernels(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(-(1 << 63), (1 << 63) - 1, (50, 3))
    rows = spark.createDataFrame([tuple(map(int, v)) for v in values], "a long, b long, c long")
    got = np.array([r[0] for r in rows.select(F.xxhash64("a", "b", "c")).collect()], np.int64)
    assert np.array_equal(got.astype(np.uint64), draws.hashed(*values.T))
    u = np.array([r[0] for r in rows.select(draws.uniform_column(4, F.col("a"), 7)).collect()])
    assert np.array_equal(u, draws.uniform(4, values[:, 0], 7)) and (u >= 0).all() and (u < 1).all()


def test_leaves_like_brute_force(spark):
    """Every point by hand through each tree, whatever the partitions; equal points are in one leaf."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6))
    x[150:] = x[3]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["tree"], r["id"]): r["leaf"] for r in knn.leaves(pts.repartition(5), trees=3, leaf=20, seed=9).collect()}
    for t in range(3):
        tree = knn.ProjectionTree(x, 20, 9 + t)
        for i in range(200):
            node = tree.root
            while node >= 0:
                at, sign, bound, low, high = tree.nodes[node]
                node = low if sum(s * x[i][a] for a, s in zip(at, sign, strict=True)) < bound else high
            assert got[t, i] == -node
        sizes = np.bincount([got[t, i] for i in range(200)])
        assert sizes.max() <= 20 + 50 and len({got[t, i] for i in range(150, 200)}) == 1


def test_local_joins_like_brute_force(spark):
    """All pairs with a common neighbour in either direction that would enter a list; hubs in parts lose only
    pairs of reverse neighbours of two parts."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5))
    x[0] = 0  # a hub
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    start = spark.createDataFrame([(i, (i + s * 7) % 60) for i in range(60) for s in (1, 2)] + [(i, 0) for i in range(1, 60)], "src long, dst long").distinct()
    d = lambda i, j: max(float(((x[i] - x[j]) ** 2).sum()), 1e-12)
    rows = [(r["src"], r["dst"], d(r["src"], r["dst"])) for r in start.collect()]
    table = knn.top_k(spark.createDataFrame(rows, "src long, dst long, d2 double"), 3)
    lists = {}
    for r in table.collect():
        lists.setdefault(r["src"], {})[r["dst"]] = r["d2"]
    bar = {i: max(own.values()) if len(own) == 3 else np.inf for i, own in lists.items()}
    near = {v: set(own) | {i for i, other in lists.items() if v in other} for v, own in lists.items()}
    want = {(i, j) for v in near for i in near[v] for j in near[v] if i != j and d(i, j) <= bar[i]}
    got = {(r["src"], r["dst"]) for r in knn.local_joins(table, pts, 3, most=100).collect()}
    assert got == want
    few = {(r["src"], r["dst"]) for r in knn.local_joins(table, pts, 3, most=5).collect()}
    assert few <= want and len(few) > 0.2 * len(want)


def test_hierarchy(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(120)], "id long, v array<double>")
    e = graph.symmetrize(knn.exact_knn(pts, 5)).select("src", "dst", fx.inv_one_plus(F.col("d2")).alias("w"))
    levels = coarsen.hierarchy(pts.select("id"), e, seed=4)
    # levels one after the other by plain loops
    own, links = list(range(120)), [(r["src"], r["dst"], r["w"]) for r in e.collect()]
    for k, level in enumerate(levels[:-1]):
        group = brute_groups(own, links, 3, 4 + k)
        assert {r["id"]: r["gid"] for r in level.vertices.collect()} == group
        heaviest = {}
        for a, b, w in links:
            if group[a] != group[b]:
                heaviest[group[a], group[b]] = max(w, heaviest.get((group[a], group[b]), 0))
        own, links = sorted(set(group.values())), [(a, b, w) for (a, b), w in heaviest.items()]
    assert sorted(r["id"] for r in levels[-1].vertices.collect()) == own
    sizes = [level.n for level in levels]
    assert len(levels) > 1 and all(b < int(0.8 * a) for a, b in zip(sizes, sizes[1:], strict=False))
    last = levels[-1].vertices
    assert last.where("id <> gid").isEmpty()
    assert levels[0].vertices.count() == 120 and levels[0].vertices.select("gid").distinct().count() == sizes[1]


def test_draws(spark):
    e = edges_of(spark, [(s, d, w) for s in range(2000) for d, w in ((0, 1.0), (1, 3.0))])
    drawn = {r["dst"]: r["count"] for r in sampling.positive_edges(e, 1).groupBy("dst").count().collect()}
    assert drawn[1] / 2000 == pytest.approx(0.75, abs=0.04)
    places = sorted(r["place"] for r in sampling.shuffled(ids(spark, 300), 9).collect())
    assert places == list(range(300))
    none = edges_of(spark, [(0, 5, 0.0), (0, 6, 0.0)])
    assert sampling.positive_edges(none, 1).first()["dst"] in (5, 6)


def test_schedules():
    assert fx.learning_rate("polynomial", 200, 0.5, 100, 0) == 200
    assert fx.learning_rate("polynomial", 200, 0.5, 100, 100) == pytest.approx(200 / math.sqrt(2))
    assert fx.learning_rate("cosine", 200, 0.5, 100, 100) == pytest.approx(0)
    assert fx.learning_rate("constant", 200, 0.5, 100, 50) == 200
    with pytest.raises(ValueError):
        fx.learning_rate("step", 1, 1, 1, 1)


RANDOM = np.random.default_rng(1)
LAYOUTS = {
    "coincident points": np.concatenate([np.zeros((300, 2)), RANDOM.normal(0, 1, (300, 2)).round(1)]),
    "far from the others": np.concatenate([RANDOM.normal(0, 1e-3, (300, 2)), RANDOM.normal(1e6, 10, (5, 2)), [[1e3, 0.0]]]),
    "equidistant, three dimensions": np.stack(np.meshgrid(range(7), range(7), range(7)), -1).reshape(-1, 3).astype(float),
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("most", [4096, 8])
def test_cells_give_the_neighbours_of_all_pairs(spark, monkeypatch, name, most):
    """Also where cells are dealt out in parts of 8."""
    monkeypatch.setattr(cells, "ALL_PAIRS", 0)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(LAYOUTS[name])], "id long, v array<double>")
    rows = lambda found: sorted(tuple(r) for r in found.select("src", "dst", "d2", "rk").collect())
    assert rows(cells.cell_knn(pts, 4, leaf=16, most=most)) == rows(knn.exact_knn(pts, 4))


def test_cells_of_few_points_and_none(spark, monkeypatch):
    few = spark.createDataFrame([(7, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    for bound in (0, cells.ALL_PAIRS):
        monkeypatch.setattr(cells, "ALL_PAIRS", bound)
        assert {(r["src"], r["dst"]) for r in cells.cell_knn(few, 4).collect()} == {(7, 3), (3, 7)}
        assert cells.cell_knn(few.limit(0), 4).count() == 0


def test_a_cell_tree_reaches_every_cell_within_a_distance():
    x = RANDOM.normal(0, 1, (400, 2))
    tree = cells.CellTree(x, 16, 5)
    _, own = zip(*sorted(zip(*tree.reached(x, np.zeros(len(x))), strict=True)), strict=True)
    assert len(own) == 400 and np.bincount(own)[1:].min() >= 5 and tree.cells > 10
    rows, found = tree.reached(x[:20], np.full(20, 0.5))
    near = np.sqrt(((x[:20, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    for i in range(20):
        assert set(np.array(own)[near[i]]) <= set(found[rows == i])
