"""Scores of a layout (id, v) against its points and labels, and of sweeps of runs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators import ranks
from vicinal.operators.cells import cell_knn
from vicinal.operators.knn import block_pairs, exact_knn, pairwise
from vicinal.session import cut


def _stats(value: Column, name: str, spread=F.stddev_pop) -> list[Column]:
    return [F.avg(value).alias(f"{name}_mean"), F.median(value).alias(f"{name}_median"), spread(value).alias(f"{name}_std"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]


def overlaps(a: DataFrame, b: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, overlap): neighbours that two tables share; 0 counts."""
    shared = a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("overlap"))
    return vertices.select("id").join(shared, "id", "left").select("id", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


def preservation(points: DataFrame, layout: DataFrame, k: int = 30) -> DataFrame:
    """One row: how many of the k nearest neighbours a layout keeps."""
    shared = overlaps(exact_knn(points, k), cell_knn(layout, k), points)
    return shared.agg(*_stats(F.col("overlap"), "knn_overlap"), (100.0 * F.avg("overlap") / k).alias("knn_overlap_pct"))


def separation(layout: DataFrame) -> DataFrame:
    """One row: distances to the nearest point, their buckets, and points that coincide."""
    away = cell_knn(layout, 1).select("src", F.when(F.col("d2") <= 1e-12, 0.0).otherwise(F.sqrt("d2")).alias("d"))
    d = F.col("d")
    buckets = [("under_01", d < 0.1), ("under_1", (d >= 0.1) & (d < 1)), ("under_10", (d >= 1) & (d < 10)), ("over_10", d >= 10)]
    near = away.agg(*_stats(d, "min_dist"), *[F.count_if(c).alias(n) for n, c in buckets])
    counts = layout.groupBy("v").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("unique_coords"), (F.sum("c") - F.count(F.lit(1))).alias("duplicate_coords"))
    # both have one row
    return near.withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one").withColumn(
        "duplicate_pct", 100.0 * F.col("duplicate_coords") / (F.col("unique_coords") + F.col("duplicate_coords"))
    )


def spread(layout: DataFrame) -> DataFrame:
    """One row: spans, deviations and distances from the origin."""
    x, y = F.col("v")[0], F.col("v")[1]
    far = F.sqrt(x * x + y * y)
    return layout.agg(
        (F.max(x) - F.min(x)).alias("x_span"), (F.max(y) - F.min(y)).alias("y_span"), F.stddev_pop(x).alias("x_std"), F.stddev_pop(y).alias("y_std"),
        F.avg(far).alias("mean_dist_from_origin"), F.median(far).alias("median_dist_from_origin"), F.max(far).alias("max_dist_from_origin"),
    )


def local_density(layout: DataFrame, k: int = 10) -> DataFrame:
    """One row: the mean distance to the k nearest."""
    mean = cell_knn(layout, k).groupBy("src").agg(F.avg(F.sqrt("d2")).alias("d"))
    return mean.agg(*_stats(F.col("d"), "local_density"))


#: Rows of a block that are measured at once.
ROWS = 16


def silhouettes(labelled: DataFrame) -> DataFrame:
    """``labelled(id, v, label)`` to (id, silhouette): distances summed for each point and cluster in blocks."""

    def kernel(ids, a, others, b, labels):
        if not len(ids) or not len(others):
            return {"src": np.empty(0, np.int64), "cluster": np.empty(0, np.int64), "total": np.empty(0), "n": np.empty(0, np.int64)}
        by = np.argsort(labels, kind="stable")
        others, b = others[by], np.ascontiguousarray(b[by].T)
        kinds, first, sizes = np.unique(labels[by], return_index=True, return_counts=True)
        total, count = np.empty((len(ids), len(kinds))), np.broadcast_to(sizes, (len(ids), len(kinds))).copy()
        meet = np.isin(ids, others)
        for at in range(0, len(ids), ROWS):
            d = np.zeros((len(ids[at : at + ROWS]), len(others)))
            for axis, column in enumerate(b):
                apart = np.subtract(a[at : at + ROWS, axis, None], column)
                d += np.multiply(apart, apart, out=apart)
            np.sqrt(d, out=d)
            if meet[at : at + ROWS].any():
                same = ids[at : at + ROWS, None] == others
                d[same] = 0.0
                count[at : at + ROWS] -= np.add.reduceat(same, first, axis=1, dtype=np.int64)
            total[at : at + ROWS] = np.add.reduceat(d, first, axis=1)
        return {"src": np.repeat(ids, len(kinds)), "cluster": np.tile(kinds, len(ids)).astype(np.int64), "total": total.ravel(), "n": count.ravel()}

    sums = block_pairs(labelled, kernel, "src long, cluster long, total double, n long", carry="label")
    means = sums.groupBy("src", "cluster").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("n").alias("n"))
    own = labelled.select(F.col("id").alias("src"), F.col("label").cast("long").alias("label"))
    joined = means.join(own, "src").groupBy("src").agg(
        F.max(F.when(F.col("cluster") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("label"), F.col("mean"))).alias("b")
    )
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return joined.select(F.col("src").alias("id"), score.alias("silhouette"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """``pairs(label, cluster)`` to one row (ari), from the contingency table."""
    two = lambda n: n * (n - 1) / 2.0
    cells = pairs.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))
    part = lambda by, name: cells.groupBy(by).agg(F.sum("n").alias("n")).select(F.lit(name).alias("kind"), two(F.col("n")).alias("s"), F.col("n").alias("n"))
    every = part("label", "a").unionByName(part("cluster", "b")).unionByName(cells.select(F.lit("c").alias("kind"), two(F.col("n")).alias("s"), "n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("s")).otherwise(0.0))
    sums = every.agg(of("a").alias("a"), of("b").alias("b"), of("c").alias("c"), F.sum(F.when(F.col("kind") == "c", F.col("n")).otherwise(0)).alias("n"))
    expected = F.col("a") * F.col("b") / two(F.col("n"))
    return sums.select(F.when((F.col("a") + F.col("b")) / 2 == expected, 1.0).otherwise((F.col("c") - expected) / ((F.col("a") + F.col("b")) / 2 - expected)).alias("ari"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the average rank of ``value`` among all: its distinct values are sorted in ranges and
    numbered within their range, so that no task orders the whole table."""
    counts = rows.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(counts.orderBy("__v").withColumn("__b", F.spark_partition_id()), "counts")
    totals = counts.groupBy("__b").agg(F.sum("__n").alias("__t"))
    # one row for each range
    base = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    upto = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.join(base, "__b").select("__v", (F.col("__base") + F.coalesce(F.sum("__n").over(upto), F.lit(0)) + (F.col("__n") + 1) / 2.0).alias(name))
    return rows.join(ranks, F.col(value) == F.col("__v")).drop("__v")


def spearman(layout: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: rank correlation of pairwise distances with differences of ``truth(id, value)``, and n_pairs.

    Up to MOST_VALUES different values no pair is written; beyond, all pairs are tables of Spark's.  A pair that
    lacks a value ranks last.
    """
    found = ranks.correlation(layout, truth)
    if found is None:
        return spearman_by_tables(layout, truth)
    return layout.sparkSession.createDataFrame([found], "spatial_correlation double, n_pairs long")


def spearman_by_tables(layout: DataFrame, truth: DataFrame) -> DataFrame:
    """``spearman`` for any values: all pairs are written with both ranks."""
    pairs = pairwise(layout).select("src", "dst", F.round(F.sqrt("d2"), 9).alias("d"))
    a = truth.select(F.col("id").alias("src"), F.col("value").alias("va"))
    b = truth.select(F.col("id").alias("dst"), F.col("value").alias("vb"))
    apart = F.coalesce(F.abs(F.col("va") - F.col("vb")).cast("double"), F.lit(float("inf")))
    pairs = pairs.join(a, "src").join(b, "dst").select("d", apart.alias("t"))
    ranked = average_ranks(average_ranks(pairs, "d", "rd"), "t", "rt")
    return ranked.agg(F.corr("rd", "rt").alias("spatial_correlation"), F.count(F.lit(1)).alias("n_pairs"))


def two_sided(r: float | None, n: int) -> float | None:
    """The chance of a correlation as far from 0 as ``r`` among ``n`` unrelated pairs, by the normal
    distribution, to which Student's comes as close as 1 / n."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else math.erfc(abs(r) * math.sqrt((n - 2) / (1 - r * r)) / math.sqrt(2))


def with_pvalue(row: DataFrame) -> DataFrame:
    """The one row of ``spearman`` with correlation_pvalue."""
    found = row.first()
    return row.withColumn("correlation_pvalue", F.lit(two_sided(found["spatial_correlation"], found["n_pairs"])).cast("double"))


def knn_classified(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, guess): the most common label of a point's neighbours, the least among equals."""
    votes = knn.select("src", "dst").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("vote")), "dst").groupBy("src", "vote").agg(F.count(F.lit(1)).alias("n"))
    guess = votes.groupBy("src").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("guess"))
    return labels.select("id", "label").join(guess.withColumnRenamed("src", "id"), "id")


def verdicts(metrics: DataFrame) -> DataFrame:
    """One row of metrics to words for collapse, duplicates, balance, span, preservation and correlation."""
    c = F.col
    span = F.greatest("x_span", "y_span")
    return metrics.select(
        F.when(c("very_close_pct") > 50, "issue").otherwise("ok").alias("collapse"),
        F.when(c("duplicate_coords") > 0, "issue").otherwise("ok").alias("duplicates"),
        F.when(c("max_cluster_pct") > 70, "issue").when(c("max_cluster_pct") > 50, "warning").otherwise("ok").alias("balance"),
        F.when(span < 10, "small").when(span > 1000, "large").otherwise("ok").alias("span"),
        F.when(c("knn_overlap_pct") < 30, "issue").when(c("knn_overlap_pct") < 50, "warning").otherwise("good").alias("preservation"),
        F.when(c("spatial_correlation") > 0.5, "good").when(c("spatial_correlation") < 0.3, "warning").otherwise("ok").alias("correlation"),
    )


def clusters(layout: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, v, label) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = layout.select("id", "v", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", "v", F.col("prediction").cast("long").alias("label"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """One row: how even the clusters (id, label) are."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        (100.0 * F.max("n") / F.sum("n")).alias("max_cluster_pct"), F.min("n").alias("min_cluster_size"),
        F.stddev_pop("n").alias("cluster_std"), (F.max("n") / F.min("n")).alias("cluster_imbalance"),
    )


# The numbers of clusters that a layout is scored for.
CLUSTERS = (3, 5, 10)


def cluster_scores(layout: DataFrame, ks: tuple[int, ...] = CLUSTERS, seed: int = 42) -> DataFrame:
    """One row: for each k the mean silhouette of k-means and how even its clusters are."""
    row = None
    for k in ks:
        found = cut(clusters(layout, k, seed), "clusters")
        own = silhouettes(found).agg(F.avg("silhouette").alias("silhouette")).withColumn("one", F.lit(1))
        own = own.join(cluster_sizes(found).withColumn("one", F.lit(1)), "one")
        own = own.select("one", *[F.col(c).alias(f"{c}_{k}") for c in own.columns if c != "one"])
        row = own if row is None else row.join(own, "one")  # each has one row
    return row.drop("one")


# ---- sweeps of runs ----


def sensitivity(runs: DataFrame, parameter: str, metric: str) -> DataFrame:
    """Mean, sample deviation (null for one run) and count of a metric for each value of a parameter."""
    return runs.groupBy(parameter).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))


def scalars(runs: DataFrame, metric: str) -> DataFrame:
    return runs.agg(F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.min(metric).alias("least"), F.max(metric).alias("most"))


def best(runs: DataFrame, metric: str, key: str, n: int = 5) -> DataFrame:
    return runs.select(key, metric).orderBy(F.desc(metric), key).limit(n)


def trend(runs: DataFrame, x: str, y: str) -> DataFrame:
    return runs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


# The parameters of each kind of sweep, those that differ in the sweep of all, and the baseline.
SWEEPS: dict[str, dict[str, list]] = {
    "K": {"k": [30, 50, 100, 150]},
    "perplexity": {"perplexity": [30, 50, 75, 100]},
    "lr": {"rate": [50, 100, 200, 400]},
    "epochs": {"epochs_coarse": [10, 25, 50, 100], "epochs_fine": [20, 50, 100, 200]},
    "mneg": {"negatives": [3, 5, 10]},
    "gamma": {"gamma": [1.0, 3.0, 5.0, 7.0]},
    "coarsening": {"pull": [2, 3, 4, 5], "shrink": [0.6, 0.7, 0.8, 0.9]},
}
COMPREHENSIVE_EPOCHS, COMPREHENSIVE_GAMMAS = [(25, 50), (50, 100), (100, 200)], [3.0, 5.0, 7.0]
BASELINE = {
    "k": 100, "perplexity": 50.0, "rate": 200.0, "epochs_coarse": 50, "epochs_fine": 100, "negatives": 5,
    "gamma_coarse": 7.0, "gamma_fine": 7.0, "pull": 3, "shrink": 0.8,
}


def sweep_configs(spark, sweep: dict[str, list]) -> DataFrame:
    """Every combination of the lists of a sweep, one row each, in order."""
    from itertools import product

    names = sorted(sweep)
    rows = [(k, *map(float, values)) for k, values in enumerate(product(*[sweep[n] for n in names]))]
    return spark.createDataFrame(rows, "test int, " + ", ".join(f"{n} double" for n in names))
