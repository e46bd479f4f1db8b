"""Multilevel coarsening of a weighted graph: greedy groups, contracted edges, representatives.

Groups form in rounds of offers.  In each round a hash of (seed, round, id) makes one free vertex in
``pull`` + 1 a seed; every other free vertex offers itself to its heaviest free seed, and a seed takes its
``pull`` heaviest offers.  A vertex without a free neighbour is a group of its own.  Small levels run the
same rounds in one task, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.draws import uniform, uniform_column
from vicinal.session import cut, drop

#: Edges up to which one task runs a level's rounds; beyond it they run over all executors, with the same result.
LOCAL_EDGES = 12_000_000


@dataclass
class Level:
    """Level 0 is the finest.  vertices (id, gid): gid is the group, and so the vertex of the next level."""

    vertices: DataFrame
    edges: DataFrame
    n: int


def offers(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, pull: int, seed: int) -> np.ndarray:
    """The group of each of the sorted ``ids``, named by its seed's id."""
    s, d = (np.searchsorted(ids, end).astype(np.int32) for end in (src, dst))
    order = np.lexsort((d, -w, s))
    s, d, w = s[order], d[order], w[order]
    gid, free, step = np.full(len(ids), -1), np.ones(len(ids), bool), 0
    while free.any():
        live = free[s] & free[d]
        s, d, w = s[live], d[live], w[live]
        alone = free.copy()
        alone[s] = alone[d] = False
        gid[alone] = np.flatnonzero(alone)
        free[alone] = False
        chosen = free & (uniform(seed, step, ids) < 1.0 / (pull + 1))
        offered = np.flatnonzero(~chosen[s] & chosen[d])
        offered = offered[np.concatenate(([True], s[offered][1:] != s[offered][:-1]))[: len(offered)]]
        a, b = s[offered], d[offered]
        by = np.lexsort((a, -w[offered], b))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))[: len(b)])
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        a, b = a[rank < pull], b[rank < pull]
        gid[a], gid[b] = b, b
        free[a] = free[b] = False
        step += 1
    return ids[gid]


def link_lists(edges: DataFrame) -> DataFrame:
    """(id, links): the edges of each src in one row, in order of dst, so that a task that takes them all gets
    16 bytes for each."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("links"))


def links(column: pa.ChunkedArray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst and w of a column of ``link_lists``, of which some are null."""
    lists = column.combine_chunks()
    dst, w = lists.flatten().flatten()
    return np.repeat(ids, lists.value_lengths().fill_null(0).to_numpy()), dst.to_numpy(), w.to_numpy()


def _grouped_locally(vertices: DataFrame, edges: DataFrame, pull: int, seed: int) -> DataFrame:
    both = vertices.select("id").join(link_lists(edges), "id", "left")

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        found = np.sort(ids)
        return pa.table({"id": found, "gid": offers(found, *links(table["links"], ids), pull, seed)})

    # bounded by LOCAL_EDGES
    return both.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "id long, gid long")


def _grouped_in_rounds(vertices: DataFrame, edges: DataFrame, pull: int, seed: int) -> DataFrame:
    free, live = cut(vertices.select("id"), "free"), edges.select("src", "dst", "w")
    done, step = None, 0
    while not free.isEmpty():
        was = free, live
        end = lambda name: free.select(F.col("id").alias(name))  # noqa: E731, B023
        live = cut(live.join(end("src"), "src").join(end("dst"), "dst"), "live")
        linked = live.select(F.col("src").alias("id")).unionByName(live.select(F.col("dst").alias("id"))).distinct()
        chosen = lambda c: uniform_column(seed, step, F.col(c)) < 1.0 / (pull + 1)  # noqa: E731, B023
        offered = live.where(~chosen("src") & chosen("dst"))
        offered = offered.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where("r = 1")
        taken = offered.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("w"), "src"))).where(F.col("r") <= pull)
        taken = cut(taken.select(F.col("src").alias("id"), F.col("dst").alias("gid")), "taken")
        alone = free.join(linked, "id", "left_anti").select("id", F.col("id").alias("gid"))
        new = cut(taken.unionByName(taken.select(F.col("gid").alias("id"), "gid").distinct()).unionByName(alone), "grouped")
        done = new if done is None else done.unionByName(new)
        free = cut(free.join(new.select("id"), "id", "left_anti"), "free")
        for table in (was[0], taken, was[1] if step else None):
            drop(table)
        step += 1
    return vertices.select("id", F.col("id").alias("gid")).limit(0) if done is None else done


def greedy_groups(vertices: DataFrame, edges: DataFrame, pull: int = 3, seed: int = 0) -> DataFrame:
    """(id, gid): every vertex in one group of at most ``pull`` + 1, named by its seed.  ``edges`` has both
    directions.  Where it is computed depends on the number of edges, what comes out doesn't."""
    if edges.count() <= LOCAL_EDGES:
        return _grouped_locally(vertices, edges, pull, seed)
    return _grouped_in_rounds(vertices, edges, pull, seed)


def coarse_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between different groups, each pair once, with the greatest weight of its members' edges."""
    a = groups.select(F.col("id").alias("src"), F.col("gid").alias("g1"))
    b = groups.select(F.col("id").alias("dst"), F.col("gid").alias("g2"))
    joined = edges.join(a, "src").join(b, "dst").where("g1 <> g2")
    return joined.groupBy(F.col("g1").alias("src"), F.col("g2").alias("dst")).agg(F.max("w").alias("w"))


def children(groups: DataFrame) -> DataFrame:
    """(gid, children): the members of each group in order; a group has at most ``pull`` + 1."""
    return groups.groupBy("gid").agg(F.sort_array(F.collect_set("id")).alias("children"))


def representatives(groups: DataFrame, degrees: DataFrame) -> DataFrame:
    """(gid, rep): the member of the highest degree, the lowest id among equals."""
    return groups.join(degrees, "id").groupBy("gid").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("rep"))


def hierarchy(vertices: DataFrame, edges: DataFrame, pull: int = 3, shrink: float = 0.8, seed: int = 0, most_levels: int = 11, least: int = 10) -> list[Level]:
    """Levels until one would shrink too little, is small, or there are ``most_levels``.  The coarsest
    level's vertices are groups of their own."""
    levels: list[Level] = []
    vertices, edges = cut(vertices.select("id"), "vertices"), cut(edges.select("src", "dst", "w"), "edges")
    n = vertices.count()
    while True:
        stop = n < least or len(levels) + 1 >= most_levels
        groups = None if stop else cut(greedy_groups(vertices, edges, pull, seed + len(levels)), "groups")
        made = 0 if stop else groups.select("gid").distinct().count()
        if stop or made >= int(shrink * n):
            levels.append(Level(vertices.withColumn("gid", F.col("id")), edges, n))
            return levels
        levels.append(Level(groups, edges, n))
        vertices = cut(groups.select(F.col("gid").alias("id")).distinct(), "vertices")
        edges, n = cut(coarse_edges(edges, groups), "edges"), made
