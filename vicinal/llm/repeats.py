"""Repeated passages: runs of consecutive lines or sentences that stand earlier in the corpus are removed.

Line dedup hashes every overlapping window of three lines; substring dedup hashes every run of several
sentences.  Windows are grouped by 128 bits of hash; the first occurrence, in order of document id and
place, stays, and what any later occurrence covers goes.  A group of occurrences is never collected: the
first one is a pre-aggregated minimum, and the others find it by a join that can be split.  Windows are cut
once and written; only those that may stand twice, and texts that may lose something, come to a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.bloom import candidates, flagged, marks
from vicinal.session import cut

WHITE = r"[ \t\n\x0B\f\r]"
#: Set between sentences; a text that holds it is taken as one sentence.
MARK = "\ue000\ue001\ue000"
#: Runs of several sentences and the characters that they must have, so that chance repeats of very short
#: ones stay.
SENTENCE_RUNS = ((3, 60), (2, 150))
#: An extra beside the runs: single sentences as long as a passage, counted apart as n_single.
LONG_SENTENCE = ((1, 280),)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    """Pieces with what stands behind them, so that joining them gives the text again.  A sentence ends
    behind ``.``, ``!`` or ``?`` and white space, or at a line's end."""
    marked = F.regexp_replace(text, rf"([.!?]{WHITE}+|\n{WHITE}*)", f"$1{MARK}")
    return F.when(F.contains(text, F.lit(MARK)), F.array(text)).otherwise(F.filter(F.split(marked, MARK, -1), lambda x: x != ""))


def _windows(units: Column, shapes: tuple[tuple[int, int], ...]) -> Column:
    """``units``: array of struct(a, b, n, at); each (width, least characters) gives windows (a, b, i, w)."""

    def of(width: int, least: int) -> Column:
        def window(i: Column) -> Column:
            own = [units[i + k] for k in range(width)]
            chars = sum((x["n"] for x in own[1:]), own[0]["n"])
            return F.struct(
                F.xxhash64(F.lit(width), *[x["a"] for x in own]).alias("a"), F.xxhash64(F.lit(width), *[x["b"] for x in own]).alias("b"),
                i.alias("i"), F.lit(width).alias("w"), chars.alias("n"),
            )

        found = F.when(F.size(units) >= width, F.transform(F.sequence(F.lit(0), F.size(units) - width), window))
        return F.filter(F.coalesce(found, F.array().cast("array<struct<a:bigint,b:bigint,i:int,w:int,n:int>>")), lambda x: x["n"] >= least)

    return F.concat(*[of(*shape) for shape in shapes])


def without_repeats(
    docs: DataFrame, id_col: str, text_col: str, split: Callable[[Column], Column], joint: str, shapes: tuple[tuple[int, int], ...]
) -> DataFrame:
    """``row`` (struct of all columns of ``docs``), doc_id, text without later repeats, n_units, n_removed, and
    n_single, how many of those only a repeat of themselves alone (a shape of width 1) takes.

    Units without a word belong to no window and stay.  Rows that are alike in id and text are one
    document and fare alike; one id on different texts stands for several documents, in order of a hash
    of the text.  Null ids come first.  A null text stays null with no units.  A text of any length is cut
    as a whole: its windows are an array in one row, some 40 bytes for each unit and shape.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    trimmed = lambda x: F.rtrim(x, F.lit(" \t\n\x0b\f\r"))
    hashed = F.transform(
        split(F.col("text")),
        lambda x, at: F.struct(F.xxhash64(trimmed(x)).alias("a"), F.xxhash64(F.lit(1), trimmed(x)).alias("b"), F.length(trimmed(x)).alias("n"), at.alias("at")),
    )
    worded = F.filter(hashed, lambda x: x["n"] > 0)
    windows = base.select("doc_id", "th", worded.alias("units")).select("doc_id", "th", F.explode(_windows(F.col("units"), shapes)).alias("x"))
    windows = cut(windows.select("doc_id", "th", "x.a", "x.b", "x.i", "x.w"), "windows")
    first = cut(
        windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "th", "i")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "first"
    )
    again = candidates(windows, marks(first, "a", "b"), "a", "b")
    later = again.join(first.hint("merge"), ["a", "b"]).where(F.struct("doc_id", "th", "i") != F.col("first"))
    gone = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("i", "w")).alias("runs"))
    cover = lambda runs: F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["i"], r["i"] + r["w"] - 1))))
    several = F.size(cover(F.filter("runs", lambda r: r["w"] > 1)))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), cover(F.col("runs")).alias("gone"), several.alias("several"))
    gone = cut(gone, "gone")
    # at every size by the same plan, which sends only texts that may lose something
    base = flagged(base, marks(gone, "g_id", "g_th"), "doc_id", "th")
    sent = base.where("f_maybe").drop("f_maybe")
    joined = sent.join(gone.hint("merge"), sent.doc_id.eqNullSafe(gone.g_id) & (sent.th == gone.g_th), "left")
    whole = base.where("not f_maybe").drop("f_maybe").withColumn("gone", F.lit(None).cast("array<int>")).withColumn("several", F.lit(None).cast("int"))
    joined = joined.select(*whole.columns).unionByName(whole)
    pieces = split(F.col("text"))
    kept = joined.select("row", "doc_id", "text", pieces.alias("pieces"), "gone", "several")
    # places among the units with a word become places among all units
    worded_at = F.transform(F.filter(F.transform("pieces", lambda x, at: F.struct(F.length(trimmed(x)).alias("n"), at.alias("at"))), lambda x: x["n"] > 0), lambda x: x["at"])
    # as an element of an array the places are found once for a text, not once for each unit that goes
    drop = F.flatten(F.transform(F.array(worded_at), lambda at: F.transform("gone", lambda k: at[k])))
    kept = kept.withColumn("drop", F.when(F.col("gone").isNotNull(), drop))
    stay = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("drop"))
    left = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.col("pieces")[k]), joint))
    return kept.select(
        "row", "doc_id", left.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("pieces")).cast("long").alias("n_units"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop") - F.col("several")).cast("long").alias("n_single"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Windows of ``width`` lines, lines without a word left out; see ``without_repeats`` for odd rows."""
    return without_repeats(docs, id_col, text_col, lines, "\n", ((width, 1),))


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shapes: tuple[tuple[int, int], ...] = SENTENCE_RUNS,
    extra: tuple[tuple[int, int], ...] = LONG_SENTENCE,
) -> DataFrame:
    """Runs of several sentences as in ``shapes``, and single ones as in ``extra`` (``()``: none); see
    ``without_repeats`` for odd rows."""
    return without_repeats(docs, id_col, text_col, sentences, "", shapes + extra)
