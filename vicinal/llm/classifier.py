"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation over the counts
of vote patterns (at most 3 ** labellers of them) finds how often each labeller votes what on good and on
bad documents; the posterior of a pattern labels its documents.  A linear scorer over hashed words and
word shapes is fitted to posteriors of a bounded sample, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.hashing import shingle_hashes, word_hashes
from vicinal.session import cut

LABELLERS = ("case", "symbols", "shouting", "repeats", "common", "length", "endings", "size")
#: Documents, about, that the scorer is fitted to, entries of feature counts of them at most, and hashed weights.
SAMPLE_DOCS, SAMPLE_ENTRIES, BUCKETS = 6000, 8_000_000, 1 << 17
# Common words of the languages.
COMMON = "the of and to in a is that it for on was der die und den zu das mit le la les de et des en un une du que el los y se".split()

_WORD_HASH = np.sort(word_hashes(" ".join(COMMON).encode()))
_UPPER, _LOWER, _SYMBOL, _SHOUT = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
_CLASS[[ord(c) for c in "!?"]] = _SHOUT
#: Shapes of words: letters by case, digits as 0; bytes beyond ASCII count as lower case.
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b > 127 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def votes(text: str | None) -> list[int]:
    """1 good, -1 bad, 0 nothing, in order of LABELLERS."""

    def vote(bad: bool, good: bool = False) -> int:
        return -1 if bad else int(good)

    data = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(data)
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0, 0, 0, -1]
    upper, lower, symbol, shout = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=5)[1:5]
    runs = np.sort(shingle_hashes(words, 5))
    again = float((runs[1:] == runs[:-1]).mean()) if len(runs) > 1 else 0.0
    known = np.searchsorted(_WORD_HASH, words)
    known[known == len(_WORD_HASH)] = 0
    common = float((_WORD_HASH[known] == words).mean())
    ends = [x.rstrip()[-1:] for x in data.split(b"\n") if x.strip()]
    ended = sum(x in b".!?" for x in ends) / len(ends)
    caps, mean = upper / max(1, upper + lower), len(data) / n
    return [
        vote(caps > 0.5),
        vote(symbol > 0.1 * n),
        vote(shout > 0.2 * n),
        vote(n >= 20 and again > 0.15),
        vote(n >= 20 and common < 0.04, n >= 20 and common > 0.12),
        vote(mean < 3 or mean > 14),
        vote(ended < 0.4, ended > 0.9),
        vote(n < 6),
    ]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each vote pattern, from a mixture of two classes with free vote rates.

    It begins with every document that a labeller calls bad as bad.  Rates have one count added so that
    none is 0.  The good class is that with more good votes.
    """
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        logs = []
        for weight in (counts * (1 - good), counts * good):
            rates = np.einsum("p,plv->lv", weight, onehot) + 1.0
            rates /= rates.sum(axis=1, keepdims=True)
            logs.append(np.log((weight.sum() + 1.0) / (counts.sum() + 2.0)) + np.einsum("plv,lv->p", onehot, np.log(rates)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    means = [(counts * w) @ patterns.mean(axis=1) / max(1e-12, (counts * w).sum()) for w in (1 - good, good)]
    return good if means[1] >= means[0] else 1 - good


def features(text: str | None) -> np.ndarray:
    """Buckets of the words, of their shapes, and of whether a run of five words has stood before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    low = np.uint64(BUCKETS // 2 - 1)
    words = word_hashes(data.lower())
    shapes = (word_hashes(data.translate(_SHAPE)) & low).astype(np.int32) + BUCKETS // 2
    again = np.ones(len(words), dtype=np.int32)
    again[np.unique(shingle_hashes(words, 5), return_index=True)[1]] = 0
    again[len(words) - 4 :] = 0
    return np.concatenate([(words & low).astype(np.int32), shapes, BUCKETS - 2 + again])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over mean features; both classes weigh the same.

    ``rows``: (buckets, counts) of each document.
    """
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(BUCKETS), 0.0
    m, v, mb, vb, t = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
    rows_at = np.array([k for k, r in enumerate(rows) if len(r[0])], dtype=np.int64)
    for _ in range(epochs if len(rows_at) else 0):
        for part in np.array_split(rng.permutation(rows_at), -(-len(rows_at) // 64)):
            flat = np.concatenate([rows[k][0] for k in part])
            counts = np.concatenate([rows[k][1] for k in part])
            of = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            scale = 3.0 * counts / np.bincount(of, weights=counts)[of]
            z = np.bincount(of, weights=weights[flat] * scale, minlength=len(part)) + bias
            y = labels[part]
            error = (1 / (1 + np.exp(-z)) - y) * np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share)) / len(part)
            g, gb, t = np.bincount(flat, weights=error[of] * scale, minlength=BUCKETS), float(error.sum()), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            weights -= rate * fix * m / (np.sqrt(v) + 1e-8)
            bias -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return weights.astype(np.float32), bias


def _code(text: str | None) -> int:
    """All votes in one number."""
    return sum((v + 1) * 3**k for k, v in enumerate(votes(text)))


def _map_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_code(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], names=["doc_id", "pattern"])


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(features(text.as_py()), return_counts=True) for text in batch.column(1)]
        codes = [_code(text.as_py()) for text in batch.column(1)]
        buckets, counts = ([r[k].astype(np.int32).tobytes() for r in rows] for k in (0, 1))
        sizes = pa.array([len(r[0]) for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(codes, pa.int32()), sizes, pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
            names=["h", "pattern", "size", "buckets", "counts"],
        )


def _sampled(own: DataFrame, total: int, sample_docs: int, entries: int) -> pd.DataFrame:
    """About ``sample_docs`` different texts by the least hash, and of them no more than ``entries`` allow.

    Where texts repeat so often that a share gives none, a larger share is drawn.
    """
    share = sample_docs / max(1, total)
    while True:
        h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
        bound = min((1 << 63) - 1, int(share * (1 << 63)))
        # one id may stand on many rows: the draw by text, too, keeps such a group's share bounded
        drawn = own.select(h.alias("h"), "text").where(F.col("h") <= bound).dropDuplicates(["h"])
        drawn = cut(drawn.mapInArrow(_map_features, "h long, pattern int, size long, buckets binary, counts binary"), "sample")
        sizes = drawn.select("h", "size").orderBy("h").limit(4 * sample_docs).toPandas()
        if len(sizes) or share >= 1 or not total:
            break
        share *= 16
    fits = sizes["h"][(sizes["size"].cumsum() <= entries) & (sizes.index < 2 * sample_docs)]
    return drawn.where(F.col("h") <= (int(fits.iloc[-1]) if len(fits) else -1)).toPandas().sort_values("h")


def _map_scores(weights: np.ndarray, bias: float, posterior: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, weak = [], []
            for value in batch.column(1):
                text = value.as_py()
                own = features(text)
                z = bias + (3.0 * float(weights[own].mean()) if len(own) else 0.0)
                scores.append(float(1 / (1 + np.exp(-z))) if len(own) else 0.0)
                weak.append(posterior[_code(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "weak_score", "score"])

    return run


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, weak_score (posterior of its votes), score (the scorer's) and kept.

    kept is a score of 0.5 or more; a text without words has a score of 0.  The scorer is fitted to about
    ``sample_docs`` documents, drawn by a hash of id and text, of any table.  A text of any length is read
    as a whole.  Repeated rows and null ids are kept as rows of their own, and rows that are alike have one
    score; an empty table gives an empty result.  Other columns aren't read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = own.mapInArrow(_map_votes, "doc_id long, pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counted = counted.sort_values("pattern")
    patterns = np.array([[p // 3**k % 3 - 1 for k in range(len(LABELLERS))] for p in counted["pattern"]]).reshape(-1, len(LABELLERS))
    good = expectation_maximisation(patterns, counted["n"].to_numpy(float)) if len(patterns) else np.empty(0)
    posterior = dict(zip(counted["pattern"].tolist(), good.tolist(), strict=True))
    sample = _sampled(own, int(counted["n"].sum()), sample_docs, SAMPLE_ENTRIES)
    rows = [tuple(np.frombuffer(bytes(x), dtype=np.int32) for x in pair) for pair in zip(sample["buckets"], sample["counts"], strict=True)]
    weights, bias = fit(rows, np.array([posterior[p] for p in sample["pattern"]]))
    scored = own.mapInArrow(_map_scores(weights, bias, posterior), "doc_id long, weak_score double, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)
