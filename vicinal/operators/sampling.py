"""Weighted draws by inverse distribution functions, and hashed orders.

A running sum over a whole table isn't taken in one task: rows are put in 65,536 hashed buckets, bucket
totals are summed up first, and rows are summed within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) for each key, whatever the partitions."""
    return F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0


def position(seed: int | str, key: Column) -> Column:
    """The same in steps of 2 to the -52, for draws among more rows than 32 bits tell apart."""
    return F.conv(F.substring(hashed(seed, key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def running(rows: DataFrame, value: str, bucket: Column, order: list) -> DataFrame:
    """``rows`` with ``before`` (the sum of all earlier rows' values) and ``total``."""
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("bucket").agg(F.sum(value).alias("own"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, "bucket").withColumn("before", F.col("base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("bucket", "base")


def shuffled(vertices: DataFrame, seed: int) -> DataFrame:
    """(id, place): every vertex once, in order of its hash."""
    rows = vertices.select("id", hashed(seed, F.col("id")).alias("h"), F.lit(1).alias("one"))
    placed = running(rows, "one", F.substring("h", 1, 4), ["h", "id"])
    return placed.select("id", F.col("before").cast("long").alias("place"))


def positive_edges(edges: DataFrame, seed: int) -> DataFrame:
    """(src, dst): an edge of each vertex, drawn by weight; equal chances where all weights are 0."""
    of = Window.partitionBy("src")
    upto = of.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    safe = F.when(F.sum("w").over(of) > 0, F.col("w")).otherwise(1.0)
    rows = edges.select("src", "dst", safe.alias("w"))
    rows = rows.select("src", "dst", (F.sum("w").over(upto) / F.sum("w").over(of)).alias("cdf"), uniform(seed, F.col("src")).alias("u"))
    # the last edge takes what rounding leaves above its own sum
    rank = F.row_number().over(of.orderBy(F.when(F.col("cdf") > F.col("u"), 0).otherwise(1), F.when(F.col("cdf") > F.col("u"), F.col("dst")).otherwise(-F.col("dst"))))
    return rows.withColumn("r", rank).where("r = 1").select("src", "dst")


def degree_cdf(degrees: DataFrame) -> DataFrame:
    """(id, lo, hi): each vertex's share of all degrees, laid end to end in hashed order."""
    rows = running(degrees, "degree", F.substring(F.md5(F.col("id").cast("string")), 1, 4), ["id"])
    total = F.lit(degrees.agg(F.sum("degree")).first()[0] or 0)
    return rows.select("id", (F.col("before") / total).alias("lo"), ((F.col("before") + F.col("degree")) / total).alias("hi"))
