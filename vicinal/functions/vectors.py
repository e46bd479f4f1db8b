"""Column expressions over coordinate arrays and coordinate columns, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least squared distance, the least denominator, and the least edge probability.
LEAST_D2, LEAST_DENOMINATOR, LEAST_P = 1e-12, 1e-18, 1e-10


def sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, LEAST_D2 or more."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.greatest(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), F.lit(LEAST_D2))


def sqdist_of(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The same of coordinate columns."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.greatest(total, F.lit(LEAST_D2))


def inv_one_plus(d2: Column) -> Column:
    return 1.0 / (1.0 + d2)


def grad_pos(yi: Sequence[Column], yj: Sequence[Column], p: Column) -> list[Column]:
    """Ascent direction of p * log(1 / (1 + d2)) for the first point."""
    scale = -2.0 * p * inv_one_plus(sqdist_of(yi, yj))
    return [scale * (a - b) for a, b in zip(yi, yj, strict=True)]


def grad_neg(yi: Sequence[Column], yk: Sequence[Column], p: Column, gamma: float) -> list[Column]:
    """Ascent direction of gamma * p * log(1 - 1 / (1 + d2)) for the first point; 0 where both coincide."""
    d2 = sqdist_of(yi, yk)
    scale = 2.0 * gamma * p / F.greatest(d2 * (1.0 + d2), F.lit(LEAST_DENOMINATOR))
    return [scale * (a - b) for a, b in zip(yi, yk, strict=True)]


def clipped(g: Sequence[Column], most: float) -> list[Column]:
    """The gradient, scaled down to a norm of ``most`` where it is longer."""
    total = F.lit(0.0)
    for x in g:
        total = total + x * x
    norm = F.sqrt(total)
    return [F.when(norm > most, x * most / norm).otherwise(x) for x in g]


def floored(p: Column) -> Column:
    return F.when(p <= 0, LEAST_P).otherwise(p)


def learning_rate(kind: str, first: float, beta: float, total: int, t: int) -> float:
    if kind == "polynomial":
        return first / (1.0 + t / total) ** beta
    if kind == "cosine":
        return first * 0.5 * (1.0 + math.cos(math.pi * t / total))
    if kind == "constant":
        return first
    raise ValueError(f"unknown schedule {kind!r}: polynomial, cosine or constant")


def learning_rate_column(kind: str, first: float, beta: float, total: int, t: Column) -> Column:
    if kind == "polynomial":
        return F.lit(first) / F.pow(1.0 + t / F.lit(float(total)), F.lit(beta))
    if kind == "cosine":
        return F.lit(first) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * t / F.lit(float(total))))
    return F.lit(first)
