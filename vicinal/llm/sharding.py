"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes on a ring of 64-bit hashes; a key belongs to the first node clockwise.  A
shard's load is bounded by its exact share (counts at most one apart); keys beyond it, the last of their
arc, go on clockwise to the first shard with room.

Rows that are alike are counted, not moved.  An arc is cut into PARTS by a hash of id, size and checksum,
so that neither an id on very many texts nor a row that is repeated very often lies in one task; its rows
stand in order of part, place and row.  The driver works on the counts of at most shards * nodes * PARTS
pieces, whatever the table's size.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import cut

#: Equal cells of the ring, by which the arc of a place is looked up.
CELL_BITS = 12
NODES = 128
#: Parts of each arc; a task ranks the rows of whole parts.
PARTS = 16
#: Rows that are alike and are written out by one task, of which there may be more.
ALIKE = 100_000


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in order; those of a shard don't depend on how many there are."""
    at = lambda s, v: int.from_bytes(hashlib.sha1(f"{s}/{v}".encode()).digest()[:8], "big", signed=True)
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def place(pieces: list[tuple[int, int, int]], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """``pieces`` (arc, piece, count) in ring order to (piece, from, to, shard, slot) runs of its rows.

    First every shard takes its own arcs' rows up to its bound; then what is left goes on clockwise.
    """
    total = sum(n for _, _, n in pieces)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, left = [0] * shards, [], []

    def take(piece: int, start: int, count: int, shard: int) -> int:
        n = min(count, room[shard] - used[shard])
        if n:
            out.append((piece, start, start + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc, piece, count in pieces:
        n = take(piece, 0, count, owners[arc])
        if n < count:
            left.append((arc, piece, n, count - n))
    onward = list(range(1, len(owners) + 1))  # from an arc to one that may have room, shortened as shards fill
    for arc, piece, start, count in left:
        while count:
            walked, at = [arc], onward[arc] % len(owners)
            while used[owners[at]] >= room[owners[at]]:
                walked.append(at)
                at = onward[at] % len(owners)
            for x in walked:
                onward[x] = at
            n = take(piece, start, count, owners[at])
            start, count = start + n, count - n
    return out


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards are at most one apart, slots are gapless from 0.  Size is the
    UTF-8 bytes of the text (null: none; any length) plus 16, and a null text has the checksum of an empty
    one.  Rows with one id, or none, stand at one place of the ring and may part where a shard is full.
    Equal texts have no part in it.  An empty table gives an empty result.  Other columns aren't read.  The
    result is the same whatever the files, partitions or size.
    """
    spark = docs.sparkSession
    circle = ring(shards, nodes)
    ends, owners = [p for p, _ in circle], [s for _, s in circle]
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.xxhash64("doc_id"))
    # the arc of a place: nodes before its cell, and those of its cell before the place
    cells = range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)
    first = [bisect.bisect_left(ends, c << (64 - CELL_BITS)) for c in cells] + [len(ends)]
    bounds = spark.createDataFrame([(c, first[k], ends[first[k] : first[k + 1]]) for k, c in enumerate(cells)], "cell int, node int, bounds array<long>")
    rows = rows.withColumn("cell", F.shiftright("at", 64 - CELL_BITS).cast("int")).join(F.broadcast(bounds), "cell")
    arc = (F.col("node") + F.size(F.filter("bounds", lambda p: p < F.col("at")))) % len(ends)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    rows = cut(rows.select("doc_id", "size", "text_crc32", "n", "at", arc.cast("int").alias("arc"), part.alias("part")), "rows")
    counts = {(r["arc"], r["part"]): r["n"] for r in rows.groupBy("arc", "part").agg(F.sum("n").alias("n")).collect()}
    keys = sorted(counts)
    runs = [(*keys[k], a, b, shard, slot) for k, a, b, shard, slot in place([(arc, k, counts[arc, p]) for k, (arc, p) in enumerate(keys)], owners, shards)]
    table = spark.createDataFrame(runs, "r_arc int, r_part int, lo long, hi long, shard int, base long")
    upto = "sum(n) over (partition by arc, part order by at, doc_id, size, text_crc32 rows between unbounded preceding and current row)"
    ranked = rows.selectExpr("*", f"{upto} as upto").withColumn("rank", F.col("upto") - F.col("n"))
    # at most shards * nodes * PARTS + shards rows
    met = ranked.join(F.broadcast(table), (F.col("arc") == F.col("r_arc")) & (F.col("part") == F.col("r_part")) & (F.col("upto") > F.col("lo")) & (F.col("rank") < F.col("hi")))
    begin = F.greatest("rank", "lo")
    met = met.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + begin - F.col("lo")).alias("slot"), (F.least("upto", "hi") - begin).alias("n"))
    many = met.where(F.col("n") > ALIKE).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE))))
    many = many.withColumn("slot", F.col("slot") + F.col("c") * ALIKE).withColumn("n", F.least(F.lit(ALIKE), F.col("n") - F.col("c") * ALIKE)).drop("c").repartition("shard", "slot")
    every = met.where(F.col("n") <= ALIKE).unionByName(many).withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)))
    return every.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
