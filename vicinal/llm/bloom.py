"""A bounded filter of keys: rows that can't have a partner stay out of a shuffle, whatever the size.

Keys set one bit each among 2 ** 24, kept as at most WORDS rows of 64 bits, which is what is broadcast.
With more keys more rows pass that have no partner, up to all of them; the join behind the filter decides,
so results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.session import cut

WORDS = 1 << 18


def _place(key: list[Column]) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit("filter"), *key)
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")


def marks(keys: DataFrame, *columns: str) -> DataFrame:
    """(f_word, f_bits) of the keys, at most WORDS rows whatever their number."""
    word, bit = _place([F.col(c) for c in columns])
    set_ = keys.select(word.alias("f_word"), bit.alias("f_bit"))
    return cut(set_.groupBy("f_word").agg(F.expr("bit_or(shiftleft(1L, f_bit))").alias("f_bits")), "marks")


def flagged(rows: DataFrame, filter_: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with f_maybe: false only where no key is equal."""
    word, bit = _place([F.col(c) for c in columns])
    bits = filter_.withColumnRenamed("f_word", "f_at")
    # at most WORDS rows
    joined = rows.withColumn("f_word", word).withColumn("f_bit", bit).join(F.broadcast(bits), F.col("f_word") == F.col("f_at"), "left")
    maybe = F.coalesce(F.expr("getbit(f_bits, f_bit)") == 1, F.lit(False))
    return joined.withColumn("f_maybe", maybe).drop("f_word", "f_bit", "f_at", "f_bits")


def candidates(rows: DataFrame, filter_: DataFrame, *columns: str) -> DataFrame:
    """The rows that may have a partner."""
    return flagged(rows, filter_, *columns).where("f_maybe").drop("f_maybe")
