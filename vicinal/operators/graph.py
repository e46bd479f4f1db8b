"""Edge lists: lookups, checks and symmetrisation.  Edges are (src, dst, w), vertices (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree); a vertex without an edge has 0."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def neighbours(edges: DataFrame, vertex: int) -> DataFrame:
    return edges.where(F.col("src") == vertex).select("dst", "w").orderBy("dst")


def weights(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with weight, 0 where there is no edge, and has_edge, a weight above 0."""
    w = F.coalesce("w", F.lit(0.0))
    return pairs.join(edges, ["src", "dst"], "left").select("src", "dst", w.alias("w"), (w > 0).alias("has_edge"))


def validate(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of what is wrong: null ends, ends that are no vertex, repeated pairs; and valid."""
    known = vertices.select("id", F.lit(1).alias("known"))
    ends = edges.select("src", "dst").join(known.select(F.col("id").alias("src"), F.col("known").alias("ks")), "src", "left")
    ends = ends.join(known.select(F.col("id").alias("dst"), F.col("known").alias("kd")), "dst", "left")
    none = F.lit(0).cast("long")
    bad = ends.select(
        (F.col("src").isNull() | F.col("dst").isNull()).cast("long").alias("null_ends"),
        ((F.col("src").isNotNull() & F.col("ks").isNull()) | (F.col("dst").isNotNull() & F.col("kd").isNull())).cast("long").alias("unknown_ends"),
        none.alias("repeated"), none.alias("n"),
    )
    again = edges.groupBy("src", "dst").agg((F.count(F.lit(1)) - 1).alias("c"))
    again = again.select(none.alias("null_ends"), none.alias("unknown_ends"), F.col("c").alias("repeated"), none.alias("n"))
    counted = vertices.select(none.alias("null_ends"), none.alias("unknown_ends"), none.alias("repeated"), F.lit(1).cast("long").alias("n"))
    sums = bad.unionByName(again).unionByName(counted).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("null_ends", "unknown_ends", "repeated", "n")])
    valid = (F.col("null_ends") == 0) & (F.col("unknown_ends") == 0) & (F.col("repeated") == 0) & (F.col("n") > 0)
    return sums.select("null_ends", "unknown_ends", "repeated", valid.alias("valid"))


def is_symmetric(edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: the largest difference of an edge's weight and its reverse's, and symmetric."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    gap = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("back", F.lit(0.0)))
    both = edges.join(back, ["src", "dst"], "full")
    worst = F.coalesce(F.max(gap), F.lit(0.0))
    return both.agg(worst.alias("worst"), (worst <= tolerance).alias("symmetric"))


def symmetrize(knn: DataFrame) -> DataFrame:
    """Edges and their reverses, each pair once, with d2 and the place among the vertex's edges."""
    both = knn.select("src", "dst", "d2").unionByName(knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2"))
    once = both.groupBy("src", "dst").agg(F.max("d2").alias("d2"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst")))
