"""Vectorised word, shingle and q-gram hashing over raw UTF-8 bytes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Every function works on one whole
text of any length; long texts are hashed block by block so that temporary arrays stay small.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0
_BASE = _U(0x9E3779B97F4A7C15)
_JOIN = _U(0xD6E8FEB86659FD93)
_EMPTY = _U((1 << 64) - 1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _blocks(data: bytes):
    """Pieces of about a megabyte that end where a word ends."""
    at, n = 0, len(data)
    while n - at > _BLOCK:
        end = at + _BLOCK
        while end < n and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _block_words(data: bytes) -> np.ndarray:
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[buf], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = np.flatnonzero(edge == -1) - starts
    first = np.zeros(len(buf), dtype=np.int64)
    first[starts] = starts - np.concatenate(([0], starts[:-1]))
    place = np.arange(len(buf)) - np.cumsum(first)
    # what stands between words is hashed as nothing, wherever it stands
    values = _BYTE[buf] * _power_table(len(buf) if len(buf) <= 4096 else int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _JOIN)


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word, in order."""
    parts = [_block_words(block) for block in _blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the word sequences of ``width``, in order; of a shorter text, the whole sequence as one."""
    k = min(width, len(words))
    if not k:
        return words
    total = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        total = total * _JOIN + words[j : len(words) - k + 1 + j]
    return mix(total + _U(k))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text with A-Z in lower case."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    found = np.sort(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower()), width))
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketch(elements: np.ndarray, bins: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketch: rounds of hashed bin placement, then forced rounds that fill every bin.

    In round i < bins each element is put in one hashed bin with a value of i plus a hashed fraction; in
    round bins + j every element goes to bin j.  A bin keeps its least value, and rounds end as soon as
    no bin is empty, so a later round can't change what an earlier one has put down.
    """
    out = np.full(bins, _EMPTY, dtype=np.uint64)
    if not len(elements):
        return out
    shift = _U(64 - bins.bit_length() + 1)
    # rounds are placed several at a time: one past the round that filled the last bin changes nothing
    together, done = max(1, -(-8 * bins // len(elements))), 0
    while done < bins:
        rounds = np.arange(done, min(bins, done + together), dtype=np.uint64)
        salt = mix(rounds + _U(seed) * _JOIN)
        h = mix(elements[None, :] + salt[:, None])
        value = (h & _U((1 << 48) - 1)) | (rounds << _U(48))[:, None]
        np.minimum.at(out, (h >> shift).ravel().astype(np.int64), value.ravel())
        done += len(rounds)
        if out.max() != _EMPTY:
            return out
    for j in np.flatnonzero(out == _EMPTY):
        h = mix(elements + mix(np.array([bins + j], dtype=np.uint64) + _U(seed) * _JOIN))
        out[j] = (h & _U((1 << 48) - 1)).min() | _U((bins + int(j)) << 48)
    return out


def band_hashes(values: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each group of ``rows`` neighbouring coordinates, told apart by its place."""
    groups = values.reshape(-1, rows)
    total = np.arange(len(groups), dtype=np.uint64) * _BASE
    for j in range(rows):
        total = total * _JOIN + groups[:, j]
    return mix(total).view(np.int64)
