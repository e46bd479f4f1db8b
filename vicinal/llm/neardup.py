"""MinHash near-dedup: similarity sketches, banding, exact verification and components.

1. A document's set is its distinct word shingles.  Equal sets fall together in one node first.
2. Each node gets a fast similarity sketch (hashed bin placement in rounds, every bin filled); bands of
   coordinates are hashed to buckets.  At similarity 0.75 two sets share none of 32 bands of 4 with a
   probability of 5e-6.
3. A bucket isn't expanded into pairs.  Its members are compared with its smallest member, the pivot, on
   full sets.  Buckets with one pivot form one group, so a pair that meets in many bands is compared once.
4. What is then in another component than its pivot is compared with all members of the group, block by
   block in workers of bounded memory; only links that join two components come out.

Nodes are numbered by themselves: neither a document's id nor a hash of it has to be unique.  One text of
each node in a group is written once for both comparisons; a bounded filter keeps the others out of the
shuffle, at every size by the same plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.bloom import candidates, flagged, marks
from vicinal.llm.components import components
from vicinal.llm.hashing import band_hashes, digest, shingle_set, sketch
from vicinal.session import cut

#: Shingles of all members that one comparing task takes, and documents on either side of it.
CHUNK_SHINGLES, LEFT_DOCS, RIGHT_DOCS = 400_000, 256, 2048


def _sketches(width: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), width)
                sizes.append(len(found))
                keys.append(digest(found))
                bands.append(band_hashes(sketch(found, bins), rows).tobytes() if len(found) else b"")
            flat = np.frombuffer(b"".join(bands), dtype=np.int64)
            ends = np.cumsum([0] + [len(b) // 8 for b in bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "th", "n_shingles", "set_key", "bands"],
            )

    return run


class _Forest:
    """Labels that are known to be of one component, within one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _compare(width: int, num: int, den: int):
    """Rows (task, side, node, label, text) in order of task and side: links of left with right documents."""

    def links(left: list, right: list, forest: _Forest) -> Iterator[tuple[int, int]]:
        if not left or not right:
            return
        sizes = np.array([len(s) for _, _, s in right])
        tokens = np.concatenate([s for _, _, s in right])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        labels = np.array([label for _, label, _ in right])
        for node, label, own in left:
            near = (den * sizes >= num * len(own)) & (den * len(own) >= num * sizes) & (labels != label)
            if not near.any():
                continue
            place = np.searchsorted(own, tokens)
            place[place == len(own)] = 0
            shared = np.add.reduceat((own[place] == tokens).astype(np.int64), at)
            for k in np.flatnonzero(near & (den * shared >= num * (sizes + len(own) - shared))):
                if forest.join(label, right[k][1]):
                    yield node, right[k][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, left, right, held, forest = None, [], [], 0, _Forest()
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for i, (of, side, node, label) in enumerate(zip(*columns, strict=True)):
                if of != task or held > CHUNK_SHINGLES:
                    out += links(left, right, forest)
                    right, held = [], 0
                    if of != task:
                        task, left, forest = of, [], _Forest()
                found = shingle_set(batch.column(4)[i].as_py(), width)
                if not len(found):
                    continue
                if side:
                    right.append((node, label, found))
                    held += len(found)
                else:
                    left.append((node, label, found))
            yield _pairs(out)
        yield _pairs(list(links(left, right, forest)))

    def _pairs(out: list) -> pa.RecordBatch:
        a, b = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return run


def _verified(tasks: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``tasks(g, i, j, side, node, label)`` to the links that join components within a task."""
    rows = tasks.join(texts, "node").select(F.xxhash64("g", "i", "j").alias("task"), "side", "node", "label", "text")
    rows = rows.repartition("task").sortWithinPartitions("task", "side")
    return cut(rows.mapInArrow(_compare(width, num, den), "a long, b long"), "found")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, bins: int, rows: int) -> DataFrame:
    """Per row of ``docs``: doc_id, th (a hash of the text), n_shingles, and of its class the least (first_id,
    first_th), both null for a row without an id or words."""
    own = _rows(docs, id_col, text_col)
    sets = cut(own.mapInArrow(_sketches(width, bins, rows), "doc_id long, th long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    nodes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "th", "n_shingles", "bands")).alias("x"))
    # numbered as they are written, so that the numbers don't change
    nodes = cut(
        nodes.select("set_key", F.monotonically_increasing_id().alias("node"), "x.doc_id", "x.th", F.col("x.n_shingles").alias("n"), "x.bands"), "sets"
    )
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "value")).select("node", "n", F.xxhash64("band", "value").alias("bucket"))
    buckets = cut(
        members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "pivot"), "buckets"
    )
    groups = cut(members.join(buckets, "bucket").where("node <> pivot").groupBy("pivot", "node").agg(F.min("n").alias("n")), "groups")
    met = groups.select("node").unionByName(groups.select(F.col("pivot").alias("node"))).distinct()
    met = cut(nodes.select("node", "doc_id", "th").join(met, "node"), "met")
    # repeated rows fall together before they are joined
    texts = candidates(own.where("doc_id is not null"), marks(met, "doc_id", "th"), "doc_id", "th").groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    texts = cut(texts.join(met.hint("merge"), ["doc_id", "th"]).select("node", "text"), "texts")

    extent = groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("t"))
    chunks = F.greatest(F.ceil(F.col("s") / RIGHT_DOCS), F.ceil(F.col("t") / CHUNK_SHINGLES)).cast("int")
    extent = cut(extent.select("pivot", chunks.alias("chunks")), "extent")
    star = (
        groups.join(extent, "pivot")
        .select("pivot", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("j"), F.lit(1).alias("side"), "node")
        .unionByName(extent.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"), F.col("pivot").alias("node")))
    )
    star = star.select(F.col("pivot").alias("g"), F.lit(0).alias("i"), "j", "side", "node", F.col("node").alias("label"))
    links = _verified(star, texts, width, num, den)

    label = components(links)
    seen = label.select(F.col("node").alias("x"), "label")
    placed = (
        groups.join(seen, groups.node == seen.x, "left")
        .select("pivot", "node", "n", F.coalesce("label", "node").alias("label"))
        .join(label.select(F.col("node").alias("pivot"), F.col("label").alias("own")), "pivot", "left")
        .select("pivot", "node", "n", "label", (F.col("label") != F.coalesce("own", "pivot")).alias("apart"))
    )
    placed = cut(placed, "placed")
    apart = F.col("apart").cast("int")
    open_groups = (
        placed.groupBy("pivot")
        .agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("t"), F.sum(apart).alias("u"), F.sum(apart * F.col("n")).alias("ut"))
        .where("u > 0 and s > 1")
        .select(
            "pivot",
            F.greatest(F.ceil(F.col("s") / RIGHT_DOCS), F.ceil(F.col("t") / CHUNK_SHINGLES)).cast("int").alias("nj"),
            F.greatest(F.ceil(F.col("u") / LEFT_DOCS), F.ceil(F.col("ut") / CHUNK_SHINGLES)).cast("int").alias("ni"),
        )
    )
    rest = placed.join(cut(open_groups, "open"), "pivot")
    right = rest.select(
        F.col("pivot").alias("g"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), "nj").cast("int").alias("j"), F.lit(1).alias("side"), "node", "label",
    )
    left = rest.where("apart").select(
        F.col("pivot").alias("g"), F.pmod(F.xxhash64("node"), "ni").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "node", "label",
    )
    more = _verified(cut(right.unionByName(left), "tasks"), texts, width, num, den)
    if not more.isEmpty():
        label = components(links.unionByName(more))
    label = label.select(F.col("node").alias("l_node"), "label")
    found = nodes.select("set_key", "node", "doc_id", "th").join(label, F.col("node") == F.col("l_node"), "left")
    found = cut(found.select("set_key", "doc_id", "th", F.coalesce("label", "node").alias("class")), "classes")
    first = found.groupBy("class").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    found = found.select("set_key", "class").join(first, "class").select(F.col("set_key").alias("c_key"), "first")
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    joined = sets.drop("bands").join(cut(found, "firsts"), has & (F.col("set_key") == F.col("c_key")), "left")
    return joined.select("doc_id", "th", "n_shingles", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    num: int = 75,
    den: int = 100,
    bins: int = 128,
    rows: int = 4,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (doc_id is component_id).

    Two rows are linked if ``den * intersection >= num * union`` of their shingle sets (64-bit hashes);
    component_id is the smallest id of a row that is reachable.  A text with fewer than ``width`` words is
    one shingle.  A null, empty or white text has the empty set and no link.  Every row stands for itself:
    one id on different texts is as several documents, each in its own text's component, and repeated rows
    fall together.  A row without an id is linked with nothing, has component_id null and is kept.  A text
    of any length is hashed as a whole, in memory of some ten times its size.  Columns other than the two
    aren't read.
    """
    found = classes(docs, id_col, text_col, width, num, den, bins, rows)
    component = F.coalesce("first_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 75, den: int = 100, bins: int = 128, rows: int = 4
) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that of the least id, and of the least hash
    of its text where one id has several; one row of those that repeat it.

    Rows without an id or a word, which are linked with nothing, all stay.
    """
    found = classes(docs, id_col, text_col, width, num, den, bins, rows).where("first_id is not null")
    found = cut(found.groupBy("doc_id", "th", "first_id", "first_th").agg(F.count(F.lit(1)).alias("c")), "members")
    stays = (F.col("doc_id") == F.col("first_id")) & (F.col("th") == F.col("first_th"))
    key = [F.col(id_col).cast("long").alias("__d"), F.xxhash64(F.col(text_col).cast("string")).alias("__t")]
    keyed = docs.select("*", *key)

    def apart(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """``rows`` with or without a partner; those that surely have none aren't sent."""
        keys = cut(keys.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")), "keys")
        marked = flagged(rows, marks(keys, "k_id", "k_th"), "__d", "__t")
        sent = marked.where("f_maybe").drop("f_maybe")
        sent = sent.join(keys.hint("merge"), (F.col("__d") == F.col("k_id")) & (F.col("__t") == F.col("k_th")), how)
        return sent if how == "left_semi" else sent.unionByName(marked.where("not f_maybe").drop("f_maybe"))

    left = apart(keyed, found.where(~stays), "left_anti")
    repeated = found.where(stays).where("c > 1")
    if not repeated.isEmpty():  # else there is nothing to fall together
        once = apart(left, repeated, "left_semi").dropDuplicates(["__d", "__t"])
        left = apart(left, repeated, "left_anti").unionByName(once)
    return left.drop("__d", "__t")
