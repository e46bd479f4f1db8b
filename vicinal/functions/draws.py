"""Draws that are the same in a plan and in a kernel: Spark's xxhash64 of whole numbers, as a Column and over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_U = np.uint64
# The primes of XXH64.
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << _U(by) | x >> _U(64 - by)


def hashed(*keys: np.ndarray | int) -> np.ndarray:
    """xxhash64 of columns of long, as unsigned numbers."""
    with np.errstate(over="ignore"):
        h = _U(42)
        for key in keys:
            x = np.asarray(key, dtype=np.int64).astype(np.uint64)
            h = h + P5 + _U(8) ^ _turn(x * P2, 31) * P1
            h = _turn(h, 27) * P1 + P4
            h = (h ^ h >> _U(33)) * P2
            h = (h ^ h >> _U(29)) * P3
            h = h ^ h >> _U(32)
        return np.atleast_1d(h)


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1), in steps of 2 to the -53."""
    return (hashed(*keys) >> _U(11)).astype(np.float64) * 2.0**-53


def uniform_column(*keys: Column | int) -> Column:
    """The same of columns."""
    longs = [(key if isinstance(key, Column) else F.lit(key)).cast("long") for key in keys]
    return F.shiftrightunsigned(F.xxhash64(*longs), 11).cast("double") * F.lit(2.0**-53)
