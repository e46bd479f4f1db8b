"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping windows.  A text region that holds a window with at most e edits
shares at least len - q + 1 - q * e of its q-grams, all within e + 1 neighbouring diagonals.  Shared
q-grams are counted in overlapping bands of 2 (e + 1) diagonals; bands that meet the bound are verified
by banded alignment.  Items under LEAST_ITEM characters are found whole, by their length and a set.

Executors cut the benchmark into distinct windows, which are written.  A block of at most about BLOCK_WINDOWS
of them is sent at a time, so neither the driver nor a worker holds more, however large the benchmark is; a
larger one takes several passes over the documents, each written before the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import cut

Q, WINDOW, STRIDE = 10, 80, 40
#: One edit for so many characters of a window.
CHARS_AN_EDIT = 16
#: Shorter items are looked for word for word, between word boundaries, without edits.
LEAST_ITEM = 30
#: Windows of the benchmark that are sent to the workers at once, about; a larger one is taken in several passes.
BLOCK_WINDOWS = 60_000
#: Places of q-grams in windows that are counted at once, about, in a part of a text; parts overlap by more
#: than a region's length, so that each region is whole in one of them.
PART_PLACES, OVERLAP = 1_000_000, 2 * WINDOW
_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
_BITS = 22
_WORD = re.compile(r"\w")
#: Where a short item may begin: at a word's first character, or at any other character but a space.
_STARTS = re.compile(r"\w+|[^\w\s]")

SPANS = "array<struct<item_id:bigint,begin:int,end:int,edits:int>>"


def normal(text: str) -> str:
    """Lower case, with one space for white space."""
    return " ".join(text.lower().split())


def qgrams(text: str) -> np.ndarray:
    """A hash of every run of Q characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < Q:
        return codes[:0]
    total, width, base = codes, 1, _BASE
    out, taken = None, 0
    for bit in range(Q.bit_length()):
        if Q >> bit & 1:
            n = len(codes) - Q + 1
            part = total[taken : taken + n]
            out = part if out is None else out * base + part
            taken += width
        total, width, base = total[:-width] * base + total[width:], 2 * width, base * base
    return out


def aligned(pattern: str, text: str, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The least edits, up to ``most``, of ``pattern`` with a part of ``text`` on diagonals low to high:
    (edits, begin, end), or None.  The alignment may begin on any diagonal of the band."""
    far, n = most + 1, len(text)
    width = high - low + 1
    cost = [0 if 0 <= low + k <= n else far for k in range(width)]
    begin = [low + k for k in range(width)]
    for i, c in enumerate(pattern):
        new, at = [far] * width, [0] * width
        for k in range(width):
            j = low + k + i + 1  # characters of the text up to here
            if 0 < j <= n:
                best, own = cost[k] + (text[j - 1] != c), begin[k]
            else:
                best, own = far, 0
            if k + 1 < width and cost[k + 1] + 1 < best and 0 <= j <= n:
                best, own = cost[k + 1] + 1, begin[k + 1]
            if k and new[k - 1] + 1 < best and j <= n:
                best, own = new[k - 1] + 1, at[k - 1]
            new[k], at[k] = best, own
        cost, begin = new, at
        if min(cost) > most:
            return None
    k = min(range(width), key=cost.__getitem__)
    return cost[k], max(0, begin[k]), min(n, low + k + len(pattern))


def windows_of(text: str | None) -> list[str]:
    """What is looked for of an item: itself if it is short, else its windows."""
    text = normal(text or "")
    last = max(0, len(text) - WINDOW)
    return [text[i : i + WINDOW] for i in sorted({*range(0, last, STRIDE), last})] if text else []


class BenchmarkIndex:
    """Windows of the items and, for each q-gram, the windows and places that hold it.

    ``windows``: (item, window), a window under LEAST_ITEM characters being a whole item.
    """

    def __init__(self, windows: list[tuple[int, str]]) -> None:
        self.windows = [(item, text) for item, text in windows if len(text) >= LEAST_ITEM]
        self.short: dict[str, list[int]] = {}
        for item, text in windows:
            if len(text) < LEAST_ITEM:
                self.short.setdefault(text, []).append(item)
        self.lengths = sorted({len(x) for x in self.short})
        sizes = np.array([len(w) for _, w in self.windows], dtype=np.int64)
        self.edits = np.minimum(sizes // CHARS_AN_EDIT, np.maximum(0, (sizes - Q) // Q))
        self.bound = np.maximum(1, sizes - Q + 1 - Q * self.edits)
        grams = [qgrams(w) for _, w in self.windows]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        window = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], dtype=np.int64))
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        self.window, self.place = window[order], place[order]
        self.keys, self.first, self.many = np.unique(every[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _BASE) >> np.uint64(64 - _BITS)

    def regions(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, edits) of every region of the normalised text, the best for each band."""
        if not text:
            return []
        text = normal(text)
        found = self._short_regions(text) + self._long_regions(text)
        return sorted(found, key=lambda x: (x[1:], x[0] is None, x[0] or 0))

    def _short_regions(self, text: str) -> list[tuple[int, int, int, int]]:
        """Whole short items: one that begins or ends with a word's character doesn't cut a word there, and one
        without any stands between spaces."""
        if not self.short:
            return []
        found = []
        for start in _STARTS.finditer(text):
            begin = start.start()
            for n in self.lengths:
                part, end = text[begin : begin + n], begin + n
                if end > len(text):
                    break
                items = self.short.get(part)
                if items is None or (_WORD.match(part[-1]) and _WORD.match(text, end)):
                    continue
                if not _WORD.search(part) and (text[begin - 1 : begin].strip() or text[end : end + 1].strip()):
                    continue
                found += [(item, begin, end, 0) for item in items]
        return found

    def _long_regions(self, text: str) -> list[tuple[int, int, int, int]]:
        if not len(self.keys):
            return []
        grams = qgrams(text)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        if not len(at):
            return []
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        real = self.keys[key] == grams[at]
        at, key = at[real], key[real]
        many = self.many[key]
        found: dict[tuple[int, int, int], int] = {}
        total, first = np.cumsum(many), 0
        while first < len(at):
            before = total[first - 1] if first else 0
            end = int(np.searchsorted(total, before + PART_PLACES, side="right"))
            end = max(end, int(np.searchsorted(at, at[first] + 2 * OVERLAP)))
            self._regions_of(text, at[first:end], key[first:end], found)
            # the next part goes back by an overlap from where this one ends
            first = max(first + 1, int(np.searchsorted(at, at[end] - OVERLAP))) if end < len(at) else end
        return [(item, a, z, e) for (item, a, z), e in found.items()]

    def _regions_of(self, text: str, at: np.ndarray, key: np.ndarray, found: dict) -> None:
        many = self.many[key]
        if many.sum() < self.bound.min():
            return
        entry = np.repeat(self.first[key] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        window = self.window[entry]
        diagonal = np.repeat(at, many) - self.place[entry]
        band = diagonal // (self.edits[window] + 1)
        wide = np.int64(len(text) + 2 * WINDOW + 4)
        code = window * wide + band + WINDOW + 2
        codes, counts = np.unique(np.concatenate([code, code - 1]), return_counts=True)
        codes = codes[counts >= self.bound[codes // wide]]
        for w, b in zip((codes // wide).tolist(), (codes % wide - WINDOW - 2).tolist(), strict=True):
            item, pattern = self.windows[w]
            most = int(self.edits[w])
            low = b * (most + 1)
            hit = aligned(pattern, text, most, low - most, low + 2 * most + 1 + most)
            if hit:
                region = (item, hit[1], hit[2])
                found[region] = min(hit[0], found.get(region, hit[0]))


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1), strict=True):
            found = windows_of(text.as_py())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.string())], names=["item_id", "text"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Distinct windows, of equal ones the least item id, block by block; one empty block if there are none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    windows = items.mapInArrow(_cut_items, "item_id long, text string").groupBy("text").agg(F.min("item_id").alias("item_id"))
    windows = cut(windows, "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()  # about BLOCK_WINDOWS
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[1], x[0] or 0))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, kept, item_ids and spans (item_id, begin, end, edits) in its normal text.

    A document is kept if no region of it matches a window of an item.  Null or empty texts and items
    match nothing; items under LEAST_ITEM characters match word for word; what several items have in common
    is named by the least of their ids, and items without an id are looked for all the same.  A text of any
    length is searched as a whole, part by part.  Repeated rows and null ids are rows of their own.  Other
    columns aren't read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.array().cast(SPANS).alias("spans"))
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        # what a pass has found is written before the next block comes
        own = (cut(own, "searched") if k else own).mapInArrow(_search(block), f"doc_id long, text string, spans {SPANS}")
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["item_id"])))
    return own.select("doc_id", (F.size("spans") == 0).alias("kept"), ids.alias("item_ids"), "spans")


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without a region, with all their columns; they are filtered where they are read."""
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        docs = (cut(docs, "searched") if k else docs).mapInArrow(_clean(block, docs.columns.index(text_col)), docs.schema)
    return docs


_indexes: dict[str, BenchmarkIndex] = {}


def index_of(block: list[tuple[int, str]]) -> BenchmarkIndex:
    """The block's index, made once in a worker, which keeps the last one."""
    key = hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = BenchmarkIndex(block)
    return _indexes[key]


def _clean(block: list[tuple[int, str]], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(block)
        for batch in batches:
            yield batch.filter(pa.array([not index.regions(text.as_py()) for text in batch.column(column)], pa.bool_()))

    return run


def _search(block: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(block)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for batch in batches:
            spans = [
                old + [dict(zip(("item_id", "begin", "end", "edits"), x, strict=True)) for x in index.regions(text.as_py())]
                for text, old in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    return run
