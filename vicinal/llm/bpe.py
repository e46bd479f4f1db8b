"""BPE encoding and decoding of whole texts with a public word-level vocabulary file.

A word's merges run over a doubly linked list of symbols and a priority queue of (rank, place); an entry
whose two symbols have changed since is stale and skipped.  Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers in each of two generations, if they aren't longer than so many characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Rows that are encoded before their results are handed back, and characters of them.
SLICE_ROWS, SLICE_CHARS = 256, 4_000_000

# Upper-case letters that the library's tables (Unicode 17) put in lower case and those of
# Python 3.13 don't know: first, last, and the distance to the lower-case letter.
LOWER_17 = [
    (0x1C89, 0x1C89, 0x1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 0x1), (0xA7CE, 0xA7CE, 0x1), (0xA7D2, 0xA7D2, 0x1),
    (0xA7D4, 0xA7D4, 0x1), (0xA7DA, 0xA7DA, 0x1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
# Letters and numbers of Unicode 16, which the library's split pattern knows and Python 3.13 doesn't.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
#: Bits of an id.
_ID = 20


def _byte_letters() -> list[str]:
    """The printable character for each byte: itself where it is printable, else the next from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _later(kind: str) -> str:
    """A character class of letters or numbers that the regex module knows and the library doesn't: those
    that Python's own tables don't know, but for those of Unicode 16."""
    known = {c for a, b in (LETTERS_16 if kind == "L" else NUMBERS_16) for c in range(a, b + 1)}
    unassigned = "".join(chr(c) for c in range(0x110000) if c not in known and unicodedata.category(chr(c)) == "Cn")
    spans: list[list[int]] = []
    for c in map(ord, regex.findall(rf"\p{{{kind}}}", unassigned)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) or "\\U0010ffff"


def _ranges(kind: str) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in (LETTERS_16 if kind == "L" else NUMBERS_16))


class _Memory:
    """What was met last: a full generation becomes the old one, and what is met again in it the new one's."""

    def __init__(self, code) -> None:
        self.code, self.young, self.old = code, {}, {}

    def __call__(self, key: str) -> tuple[str, str]:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key) or self.code(key)
            if len(key) <= REMEMBERED_CHARS:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found


class BytePairCodec:
    """Encoder and decoder for a vocabulary file with byte letters, an end-of-word suffix and no decoder.

    The file's normaliser (NFC, white space, lower case) and split pattern are followed; strings of its
    added tokens are taken from the raw text first.  No match of the pattern holds white space, so that it
    needn't be made one space.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.strings |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.letters = _byte_letters()
        self.inner = [vocab.get(x, -1) for x in self.letters]
        self.last = [vocab.get(x + self.suffix, -1) for x in self.letters]
        # two ids in one number to the pair's rank and new id in one number
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << _ID | vocab[b], rank << _ID | vocab[a + b])
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        split = split.replace(r"\s", r"\p{White_Space}")
        self.find_words = regex.compile(split).findall
        rare = {kind: _later(kind) for kind in "LN"}
        for kind, those in rare.items():
            split = split.replace(rf"\p{{{kind}}}", rf"[[\p{{{kind}}}--[{those}]]||[{_ranges(kind)}]]")
        upper = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, _ in LOWER_17)
        self.has_rare = regex.compile("[" + "".join(rare.values()) + _ranges("L") + _ranges("N") + upper + "]").search
        self.find_words_exactly = regex.compile(split, regex.V1).findall
        self.lower = {c: c + by for a, b, by in LOWER_17 for c in range(a, b + 1)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split
        self.word = _Memory(self._word)

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.word_ids(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word: the lowest rank first, the leftmost among equals."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        if -1 in symbols:
            symbols = [x for x in symbols if x >= 0]
        n, get = len(symbols), self.pairs.get
        places = 20 if n < 1 << 20 else 40
        low = (1 << places) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [v << places | i for i in range(n - 1) if (v := get(symbols[i] << _ID | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & low
            j = after[i]
            if symbols[i] < 0 or j >= n or get(symbols[i] << _ID | symbols[j]) != entry >> places:
                continue  # stale: merged itself, or a neighbour has been since
            new = symbols[i] = entry >> places & (1 << _ID) - 1
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := get(new << _ID | symbols[k])) is not None:
                    heapq.heappush(queue, v << places | i)
            k = before[i]
            if k >= 0 and (v := get(symbols[k] << _ID | new)) is not None:
                heapq.heappush(queue, v << places | k)
        return [x for x in symbols if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, one space between; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without added tokens."""
        if text.isascii():
            return self.find_words(text.lower())
        text = unicodedata.normalize("NFC", text)
        exactly = False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # one character at a time has no rule for a final sigma
            text = text.replace("Σ", "σ")
            if exactly := self.has_rare(text) is not None:
                text = text.translate(self.lower)
        return (self.find_words_exactly if exactly else self.find_words)(text.lower())

    def encode(self, text: str | None) -> tuple[str, str]:
        """Ids in decimal, joined by one space, and the decoded text; both empty without a word."""
        if not text:
            return "", ""
        ids, strings = [], []
        for k, part in enumerate(self.find_added(text) if "<|" in text else (text,)):
            if k % 2:
                ids.append(str(self.added[part]))
                strings.append(part)
                continue
            words = self.words(part)
            coded = list(map(self.word.young.get, words))
            if None in coded:
                coded = [x or self.word(word) for x, word in zip(coded, words, strict=True)]
            ids += [x for x, _ in coded]
            strings += [x for _, x in coded]
        return " ".join(ids), " ".join(strings)


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec for each worker and file."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def bpe_codes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (decimal, joined by one space) and decoded.

    A null, empty or white text has no ids and decodes to an empty text.  A text of any length is encoded
    as a whole; its memory is a multiple of its own size.  Repeated rows and null ids are kept as they are;
    other columns aren't read.  ``path`` must exist where the workers run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                coded, first, chars = [], at, 0
                while at < whole.num_rows and at - first < SLICE_ROWS and chars < SLICE_CHARS:
                    coded.append(encode(whole.column(1)[at].as_py()))
                    chars, at = chars + len(coded[-1][1]), at + 1
                counts = pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in coded], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(first, at - first), counts, pa.array([x for x, _ in coded], pa.string()), pa.array([x for _, x in coded], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def bpe_texts(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The way back: decimal ids joined by one space to (doc_id, decoded); null is as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [decode([int(i) for i in (ids or "").split()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")
