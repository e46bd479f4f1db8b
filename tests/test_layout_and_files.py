"""Layouts, scores and files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import coarsen, evaluate, layout
from vicinal.sources import vectors as files


def blobs(spark, groups=5, each=24, dims=10):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (groups, dims))
    order = rng.permutation(groups * each)
    x = np.concatenate([rng.normal(c, 0.5, (each, dims)) for c in centres])[order]
    label = np.repeat(np.arange(groups), each)[order]
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, label long")


def test_layout_keeps_blobs_apart(spark):
    pts = blobs(spark)
    config = layout.Config(k=12, perplexity=8.0, epochs_coarse=150, epochs_fine=150, seed=1)
    found = layout.embed(spark, pts.select("id", "v"), config)
    flat = found.select("id", F.array("x", "y").alias("v")).join(pts.select("id", "label"), "id")
    assert flat.count() == 120
    assert evaluate.silhouettes(flat).agg(F.avg("silhouette")).first()[0] > 0.3
    again = layout.embed(spark, pts.select("id", "v"), config)
    assert found.join(again.withColumnRenamed("x", "x2"), "id").agg(F.max(F.abs(F.col("x") - F.col("x2")))).first()[0] == 0.0


def test_three_dimensions_and_bad_configs(spark):
    config = layout.Config(k=8, dim=3, perplexity=5.0, epochs_coarse=3, epochs_fine=3)
    assert layout.embed(spark, blobs(spark, 2, 20).select("id", "v"), config).columns == ["id", "x", "y", "z"]
    for bad in ({"dim": 4}, {"direction": "up"}, {"k": 0}, {"schedule": "step"}):
        with pytest.raises(ValueError):
            layout.Config(**bad)
    assert layout.Config.compatible().most_norm == 10.0


def test_scores(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [3.0, 4.0], 1), (3, [3.0, 5.0], 1)]
    flat = spark.createDataFrame(rows, "id long, v array<double>, label long")
    s = evaluate.separation(flat.select("id", "v")).first()
    assert (s["unique_coords"], s["duplicate_coords"], s["min_dist_min"], s["under_01"]) == (3, 1, 0.0, 2)
    assert evaluate.spread(flat).first()["max_dist_from_origin"] == pytest.approx(np.hypot(3, 5))
    assert evaluate.adjusted_rand(flat.select("label", F.col("label").alias("cluster"))).first()["ari"] == 1.0
    assert evaluate.silhouettes(flat).where("id = 0").first()["silhouette"] == pytest.approx(1.0)
    runs = spark.createDataFrame([("a", 30, 1.0), ("b", 30, 3.0), ("c", 50, 5.0)], "t string, k int, m double")
    got = {r["k"]: (r["mean"], r["std"]) for r in evaluate.sensitivity(runs, "k", "m").collect()}
    assert got[30] == (2.0, pytest.approx(2**0.5)) and got[50] == (5.0, None)
    assert [r["t"] for r in evaluate.best(runs, "m", "t", 2).collect()] == ["c", "b"]


def test_raw_files(spark, tmp_path):
    x = (0.1 * np.arange(1000, dtype=np.float32)).reshape(100, 10)
    path = str(tmp_path / "x.f32")
    files.write_raw(x, path)
    back = np.array([r["features"] for r in files.read_vectors(spark, path, 100, 10).orderBy("id").collect()], np.float32)
    assert np.array_equal(back, x)
    strided = np.array([r["features"] for r in files.read_raw(spark, path, 98, 4, stride=10, offset=3).orderBy("id").collect()], np.float32)
    assert np.array_equal(strided, x[:98, 3:7])
    with pytest.raises(ValueError):
        files.read_raw(spark, path, 101, 10)


def test_fvecs(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    path = str(tmp_path / "x.fvecs")
    files.write_fvecs(x, path)
    back = np.array([r["features"] for r in files.read_vectors(spark, path, 3, 4).orderBy("id").collect()], np.float32)
    assert np.array_equal(back, x)
    with pytest.raises(ValueError):
        files.read_fvecs(spark, path, 3, 5)
    with pytest.raises(ValueError):
        files.read_fvecs(spark, path, 4, 4)
    bad = tmp_path / "bad.fvecs"
    bad.write_bytes((tmp_path / "x.fvecs").read_bytes()[:20] + struct.pack("<i", 5) + bytes(36))
    with pytest.raises(Exception, match="dimension"):
        files.read_fvecs(spark, str(bad), 3, 4).collect()


def test_layout_files(spark, tmp_path):
    at = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(10)], "id long, x double, y double")
    raw, folder = files.write_layout(at, str(tmp_path / "out.v1.csv"))
    assert np.array_equal(np.fromfile(raw, "<f4").reshape(10, 2)[3], [3, 6])
    assert [tuple(r) for r in files.read_layout(spark, folder).orderBy("id").collect()][3] == (3, 3.0, 6.0)
    with pytest.raises(ValueError):
        files.write_layout_csv(at.select("id", "x"), str(tmp_path / "bad"))
    np.save(tmp_path / "l.npy", np.array([1, 0], np.int32))
    assert files.read_labels(spark, str(tmp_path / "l.npy")).count() == 2
    assert files.read_labels(spark, str(tmp_path / "none.npy")) is None


def test_vectors_of_a_table(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(70, 6)).astype("f4")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<float>").repartition(4)
    for name in ("x.f32", "x.fvecs"):
        assert files.write_vectors(table, str(tmp_path / name)) == 70
    assert np.array_equal(np.fromfile(tmp_path / "x.f32", "<f4").reshape(70, 6), x)
    for back in (files.read_matrix(spark, str(tmp_path / "x.f32"), 6), files.read_vectors(spark, str(tmp_path / "x.fvecs"), 70, 6)):
        assert np.array_equal(np.array([r["features"] for r in back.orderBy("id").collect()], "f4"), x)
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(tmp_path / "x.f32"), 11)
    with pytest.raises(ValueError):
        files.write_vectors(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, features array<float>"), str(tmp_path / "bad.f32"))


def test_cluster_scores_and_pvalue(spark):
    flat = spark.createDataFrame([(i, [float(i // 10) * 50 + 0.1 * (i % 10), 0.1 * (i % 3)]) for i in range(30)], "id long, v array<double>")
    row = evaluate.cluster_scores(flat, (3,)).first()
    assert row["silhouette_3"] > 0.9 and row["min_cluster_size_3"] == 10 and row["cluster_imbalance_3"] == 1.0
    assert evaluate.two_sided(0.0, 100) == 1.0 and evaluate.two_sided(0.2, 1000) < 1e-9 and evaluate.two_sided(None, 5) is None
    assert evaluate.two_sided(0.05, 1000) == pytest.approx(0.114, abs=0.001)
    truth = flat.select("id", F.col("v")[0].alias("value"))
    assert evaluate.with_pvalue(evaluate.spearman(flat, truth)).first()["correlation_pvalue"] < 1e-6


def test_runs(spark, tmp_path):
    path = tmp_path / "results.json"
    path.write_text('[{"success": true, "test_id": "K_30", "m": 1.5, "config": {"K": 30}}, {"success": false, "test_id": "x", "config": {"K": 50}}]')
    rows = files.read_runs(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["config_K"] == 30


def test_negatives_of_large_levels(spark):
    n, groups = 200_000, 300_000
    degree = spark.range(n).select("id", (F.col("id") % 2 + 1).alias("degree"))
    pool = layout.negative_pool(degree, n).cache()
    base = spark.range(groups).select(F.lit(0).alias("epoch"), F.col("id").alias("gid"), F.col("id").alias("i"), F.lit(1).cast("long").alias("j"))
    found = layout.with_negatives(base, pool, 5, 1).cache()
    assert found.count() == groups and found.where("size(negatives) <> 5 or array_contains(negatives, j)").isEmpty()
    drawn = found.select(F.explode("negatives").alias("n"))
    by = {r["d"]: (r["c"], r["v"]) for r in drawn.groupBy((F.col("n") % 2 + 1).alias("d")).agg(F.count("n").alias("c"), F.count_distinct("n").alias("v")).collect()}
    # a step is shared by degree, and nearly every vertex is met
    assert by[2][0] / by[1][0] == pytest.approx(2, rel=0.02) and by[1][1] + by[2][1] > 199_000
    # what equals j is drawn again among the others, by their degrees
    three = layout.negative_pool(spark.createDataFrame([(1, 6), (2, 1), (3, 3)], "id long, degree long"), 3)
    met = {r["n"]: r["count"] for r in layout.with_negatives(base.limit(20_000), three, 5, 1).select(F.explode("negatives").alias("n")).groupBy("n").count().collect()}
    assert 1 not in met and met[2] + met[3] == 100_000 and met[3] / met[2] == pytest.approx(3, rel=0.05)
    assert layout.with_negatives(base, three, 0, 1).where("size(negatives) > 0").isEmpty()


@pytest.mark.parametrize("dim", [2, 3])
def test_where_epochs_run_changes_nothing(spark, monkeypatch, dim):
    """A level with groups of several members and a vertex without an edge, in one task and as joins."""
    rng = np.random.default_rng(5)
    n, axes = 40, list("xyz"[:dim])
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n - 1, (90, 2)) if a != b}
    weight = {frozenset(p): float(rng.random()) for p in pairs}
    edges = spark.createDataFrame(sorted({(a, b, weight[frozenset((a, b))]) for x, y in pairs for a, b in ((x, y), (y, x))}), "src long, dst long, w double")
    vertices = spark.createDataFrame([(k, k // 3 if k < n - 1 else 99) for k in range(n)], "id long, gid long")
    at = spark.createDataFrame([(k, k // 3 if k < n - 1 else 99, *map(float, rng.normal(size=dim))) for k in range(n)], "id long, gid long, " + ", ".join(f"{c} double" for c in axes))
    config = layout.Config(k=3, dim=dim)
    found = []
    for most in (0, layout.LOCAL_EDGES):
        monkeypatch.setattr(layout, "LOCAL_EDGES", most)
        monkeypatch.setattr(layout, "DRAWN_EPOCHS", 2)
        moved = layout.optimize_level(layout.Level(vertices, edges, n), at, config, 3, 7.0, 11)
        assert moved.columns == ["id", "gid", *axes]
        found.append(np.array([[r[c] for c in axes] for r in moved.orderBy("id").collect()]))
    assert np.abs(found[0] - found[1]).max() <= 1e-9 * np.abs(found[0]).max()
    before = np.array([[r[c] for c in axes] for r in at.orderBy("id").collect()])
    assert (found[0] != before).any(axis=1).all()


def test_epochs_like_brute_force():
    """Groups move at once, by the gradient of their representative from where all stood."""
    rng = np.random.default_rng(7)
    n = 90
    src, dst = np.nonzero(rng.random((n, n)) < 0.1)
    gids = rng.integers(0, 30, n)
    config = layout.Config(k=5, most_norm=10.0)
    kernel = layout.LevelKernel(np.arange(n), gids, src, dst, rng.random(len(src)), config)
    want = rng.normal(size=(n, 2))
    got = kernel.run(want.copy(), 4, 7.0, 3)
    for epoch in range(4):
        j, p, negative = kernel.draws(epoch, 3)
        was = want.copy()
        for k, i in enumerate(kernel.rep):
            to = was[i] - was[j[k]]
            g = -2 * p[k] * to / (1 + max((to**2).sum(), 1e-12))
            for m in negative[k]:
                away = was[i] - was[m]
                d2 = max((away**2).sum(), 1e-12)
                g = g + 14 * p[k] / max(d2 * (1 + d2), 1e-18) * away
            g *= min(1.0, 10 / np.sqrt((g**2).sum()))
            want[kernel.group == k] += 200 / np.sqrt(1 + epoch / 4) * g
        assert all(j[k] in dst[src == i] and j[k] not in negative[k] for k, i in enumerate(kernel.rep) if (src == i).any())
    assert np.abs(got - want).max() <= 1e-6 * np.abs(want).max()


def test_large_levels_in_three_dimensions(spark, monkeypatch):
    monkeypatch.setattr(layout, "LOCAL_EDGES", 1)
    vertices = spark.createDataFrame([(k, k) for k in range(4)], "id long, gid long")
    edges = spark.createDataFrame([(a, b, 0.5) for a in range(4) for b in range(4) if a != b], "src long, dst long, w double")
    rows = [(k, k, 0.1 * k, 0.3 * k * k, 0.2 - k) for k in range(4)]
    at = spark.createDataFrame(rows, "id long, gid long, x double, y double, z double")
    config = layout.Config(k=1, dim=3)
    moved = layout.optimize_level(layout.Level(vertices, edges, 4), at, config, 2, 7.0, 1)
    assert moved.columns == ["id", "gid", "x", "y", "z"]
    assert moved.count() == 4 and moved.join(at.select("id", F.col("z").alias("z0")), "id").where("z = z0").isEmpty()
    # one epoch by hand: 0 is drawn to 1 and pushed off 2, in z as in x and y
    sample = spark.createDataFrame([(0, 0, 1, [2])], "gid long, i long, j long, negatives array<long>")
    got = layout.synchronous_epoch(at, edges, sample, 1.0, 7.0, 1e9).where("id = 0").first()
    y = np.array([r[2:] for r in rows])
    near, far = ((y[0] - y[1]) ** 2).sum(), ((y[0] - y[2]) ** 2).sum()
    want = y[0] - (y[0] - y[1]) / (1 + near) + 7 / (far * (1 + far)) * (y[0] - y[2])
    assert [got["x"], got["y"], got["z"]] == pytest.approx(list(want))


def test_level_of_a_hundred_thousand_points_in_one_task(spark, monkeypatch):
    """Five million edges; failed before, as each epoch was a join."""
    monkeypatch.setattr(layout, "_optimize_together", None)
    n, k = 100_000, 50
    edges = spark.range(n * k).select(F.floor(F.col("id") / k).alias("src"), ((F.floor(F.col("id") / k) + F.col("id") % k + 1) % n).alias("dst"), F.lit(0.5).alias("w"))
    vertices = spark.range(n).select("id", (F.col("id") - F.col("id") % 4).alias("gid"))
    at = vertices.select("id", "gid", F.rand(1).alias("x"), F.rand(2).alias("y")).cache()
    moved = layout.optimize_level(coarsen.Level(vertices, edges, n), at, layout.Config(), 2, 7.0, 0)
    assert moved.count() == n and moved.join(at.select("id", F.col("x").alias("was")), "id").where("x = was").isEmpty()


def test_epochs_from_the_edges_of_representatives_alone():
    rng = np.random.default_rng(3)
    n = 60
    pairs = np.unique(rng.integers(0, n, (400, 2)), axis=0)
    src, dst = pairs[pairs[:, 0] != pairs[:, 1]].T
    w, gids, config = rng.random(len(src)), np.arange(n) // 4, layout.Config()
    full = layout.LevelKernel(np.arange(n), gids, src, dst, w, config)
    own = np.isin(src, full.rep)
    part = layout.LevelKernel(np.arange(n), gids, src[own], dst[own], w[own], config, np.bincount(src, minlength=n))
    y = rng.normal(size=(n, 2))
    assert np.allclose(full.run(y, 20, 7.0, 1), part.run(y, 20, 7.0, 1))


def test_silhouettes_measure_many_rows_at_once(monkeypatch):
    """The sums of a loop over points, in less than half of its time; failed before, as it was that loop."""
    import time

    found = []
    monkeypatch.setattr(evaluate, "block_pairs", lambda labelled, kernel, *_, **__: found.append(kernel) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        evaluate.silhouettes(None)
    rng = np.random.default_rng(4)
    ids, x, labels = rng.permutation(2000), rng.normal(size=(2000, 2)), rng.integers(0, 10, 2000)
    began = time.process_time()
    total = np.stack([np.bincount(labels, np.sqrt(((x - p) ** 2).sum(axis=1)) * (ids != i), 10) for i, p in zip(ids, x, strict=True)])
    count = np.stack([np.bincount(labels, ids != i, 10) for i in ids])
    loop, began = time.process_time() - began, time.process_time()
    got = found[0](ids, x, ids, x, labels)
    assert time.process_time() - began < loop / 2
    assert np.allclose(got["total"].reshape(2000, 10), total, rtol=1e-12) and np.array_equal(got["n"].reshape(2000, 10), count)
    assert got["src"].tolist() == np.repeat(ids, 10).tolist() and got["cluster"].tolist() == list(range(10)) * 2000
    assert not len(found[0](ids[:0], x[:0], ids, x, labels)["src"]) and not len(found[0](ids, x, ids[:0], x[:0], labels[:0])["src"])
