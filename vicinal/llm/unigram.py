"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming carries the
best score and its number of pieces to each place.  Tie rules are those of the tokenizers library: among
equal scores the match that starts first stands; a character that is no piece of its own counts as
unknown, at the least score less 10, and as its UTF-8 bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
REMEMBERED_WORDS = 400_000
#: Longer words are counted each time.
REMEMBERED_CHARS = 80


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0) -> None:
        self.find = ahocorasick.Automaton()
        known = {}
        for i, (piece, score) in enumerate(pieces):
            if piece:
                known[piece] = (len(piece), score, i == unknown_id)
        for piece, value in known.items():
            self.find.add_word(piece, value)
        self.find.make_automaton()
        self.single = {piece for piece in known if len(piece) == 1}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown = min(score for _, score in pieces) - 10.0
        self._counts: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word that begins with the space mark."""
        n, single, unknown = len(word), self.single, self.unknown
        best, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        end, top, pieces, open_run = 1, None, 0, False

        def settle(upto: int) -> None:
            """Places before ``upto`` have no more matches: an unknown character may still end there."""
            nonlocal end, top, pieces, open_run
            while end < upto:
                if word[end - 1] not in single and (top is None or best[end - 1] + unknown > top):
                    top, pieces, open_run = best[end - 1] + unknown, self._unknown(word[end - 1], count[end - 1], run[end - 1]), True
                best[end], count[end], run[end] = top, pieces, open_run
                end, top = end + 1, None

        # matches come in order of their ends, and of one end the longest first
        for last, (length, score, is_unknown) in self.find.iter(word):
            if last >= end:
                settle(last + 1)
            start = last + 1 - length
            value = best[start] + score
            if top is None or value > top:
                top, open_run = value, is_unknown
                pieces = self._unknown(word[start : last + 1], count[start], run[start]) if is_unknown else count[start] + 1
        settle(n + 1)
        return count[n]

    def _unknown(self, text: str, before: int, after_unknown: bool) -> int:
        """With byte pieces one for each byte; else one for each run of unknown characters."""
        return before + (len(text.encode("utf-8", "surrogatepass")) if self.bytes else not after_unknown)

    def count(self, text: str | None) -> int:
        """A space begins a word, and so does the text; spaces are marks of their own word."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        try:
            return sum(map(self._counts.__getitem__, words))
        except KeyError:
            if len(self._counts) > REMEMBERED_WORDS:
                self._counts.clear()
            total = 0
            for word in words:
                found = self._counts.get(word)
                if found is None:
                    found = self.word(SPACE + word)
                    if len(word) <= REMEMBERED_CHARS:
                        self._counts[word] = found
                total += found
            return total


_counters: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and n_tokens.

    A null or empty text has 0 tokens; a text of spaces has one or more for each.  A text of any length is
    counted as a whole, word by word.  Repeated rows and null ids are kept; an empty table gives an empty
    result, and other columns aren't read.  ``path`` must exist where the workers run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = UnigramCounter(read_pieces(path))
        count = _counters[path].count
        for batch in batches:
            counts = pa.array([count(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["doc_id", "n_tokens"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long")
