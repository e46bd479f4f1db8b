"""Perplexity-calibrated edge probabilities over an edge list (src, dst, d2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.vectors import LEAST_P

# Fixed values of the search.
LOW, HIGH, START, TOLERANCE, ROUNDS, LEAST_WIDTH = 1e-10, 1000.0, 1.0, 1e-2, 100, 1e-10


#: Distances of vertices that are searched together, about.
TOGETHER = 1 << 20


def perplexity(edges: DataFrame, sigma: float) -> DataFrame:
    """(src, perplexity) at one sigma."""
    of = Window.partitionBy("src")
    e = edges.select("src", "d2", F.min("d2").over(of).alias("m"))
    e = e.select("src", F.exp((F.col("m") - F.col("d2")) / (2.0 * sigma * sigma)).alias("e"))
    p = e.select("src", (F.col("e") / F.sum("e").over(of)).alias("p"))
    h = F.sum(F.when(F.col("p") > 1e-10, -F.col("p") * F.log2("p")).otherwise(0.0))
    return p.groupBy("src").agg(F.pow(F.lit(2.0), h).alias("perplexity"))


def searched(lists: list[np.ndarray], target: float) -> np.ndarray:
    """The sigma of each list of squared distances, by bisection of all at once.

    Its perplexity is 2 to the entropy of the softmax of -d2 / (2 sigma^2); shares of 1e-10 or less count as none.
    """
    sizes = np.array([len(x) for x in lists])
    d = np.full((len(lists), sizes.max()), np.inf)
    d[np.arange(d.shape[1]) < sizes[:, None]] = np.concatenate(lists)
    d -= d.min(axis=1)[:, None]
    low, high, sigma = np.full(len(d), LOW), np.full(len(d), HIGH), np.full(len(d), START)
    live = np.arange(len(d))
    for _ in range(ROUNDS):
        s = sigma[live]
        e = np.exp(-d[live] / (2.0 * s * s)[:, None])
        p = e / e.sum(axis=1)[:, None]
        h = np.where(p > 1e-10, -p * np.log2(np.maximum(p, 1e-300)), 0.0).sum(axis=1)
        found = 2.0**h
        under, far = found < target, np.abs(found - target) >= TOLERANCE
        low[live[far & under]] = s[far & under]
        high[live[far & ~under]] = s[far & ~under]
        live = live[far]
        sigma[live] = (low[live] + high[live]) / 2.0
        live = live[high[live] - low[live] >= LEAST_WIDTH]
        if not len(live):
            break
    return sigma


def sigmas(edges: DataFrame, target: float) -> DataFrame:
    """(src, sigma) by bisection over a vertex's distances, many vertices at once in a kernel.

    A vertex holds its own list, as long as its degree.  A target above the degree can't be met; sigma
    then runs up to its bound.
    """
    lists = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.col("d2").cast("double"))).alias("ds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")  # lists of about one length together
            sigma, at = np.empty(len(order)), 0
            values, ends = batch.column(1).flatten().to_numpy(), np.cumsum(sizes)
            while at < len(order):
                end = at + 1
                while end < len(order) and (end + 1 - at) * sizes[order[end]] <= TOGETHER:
                    end += 1
                part = order[at:end]
                sigma[part] = searched([values[ends[k] - sizes[k] : ends[k]] for k in part], target)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigma)], names=["src", "sigma"])

    return lists.mapInArrow(run, "src long, sigma double")


def conditional(edges: DataFrame, sigma: DataFrame) -> DataFrame:
    """(src, dst, p): the softmax of each vertex's distances at its sigma."""
    of = Window.partitionBy("src")
    e = edges.join(sigma, "src").withColumn("m", F.min("d2").over(of))
    e = e.withColumn("e", F.exp((F.col("m") - F.col("d2")) / (2.0 * F.col("sigma") * F.col("sigma"))))
    return e.select("src", "dst", (F.col("e") / F.sum("e").over(of)).alias("p"))


def pij(edges: DataFrame, n: int, target: float) -> DataFrame:
    """(src, dst, w): both conditional probabilities over 2n, LEAST_P at least."""
    p = conditional(edges, sigmas(edges, target))
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("back"))
    w = (F.col("p") + F.coalesce("back", F.lit(0.0))) / (2.0 * n)
    return p.join(back, ["src", "dst"], "left").select("src", "dst", F.when(w <= 0, LEAST_P).otherwise(w).alias("w"))
