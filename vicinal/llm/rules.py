"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has a histogram of character classes and one of its language's common words.  The
language's reference is the median share of every class over all documents of that language that pass
the base rules and are long enough; a document goes if a histogram's Jensen-Shannon distance from the
reference is too large.  Short documents and languages without a word list aren't judged by words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.session import cut

# Common words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
#: Classes of characters other than lower case, which is what is left, and white space.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:]", "shout": r"[!?]", "symbol": r"[#*$%&|<>]"}
WHITE = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Words from which on characters and common words are judged and count in the references.
LEAST_CHAR_WORDS, LEAST_WORD_WORDS = 20, 60
#: Largest Jensen-Shannon distances that pass, for long texts; a text of n words may have SLACK / n more.
MOST_CHAR, MOST_WORD, SLACK = 0.20, 0.22, 5.0
N_CHAR, N_WORD = len(CLASSES) + 2, len(COMMON["en"]) + 1


def _hits(k: int) -> Column:
    return F.size(F.filter("common", lambda w: w == F.col("own")[k]))


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The base counts, and c0.. and w0.., the histograms' shares rounded to three places; and ``row``, a
    struct of all columns of ``docs``."""
    text = F.col(text_col).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    every = sorted({w for words in COMMON.values() for w in words})
    d = d.select(
        "row", "doc_id", "lang", "text",
        F.filter(F.split("text", f"{WHITE}+", -1), lambda w: w != "").alias("ws"),
        F.regexp_replace("text", r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    without = lambda p: F.length("rest") - F.length(F.regexp_replace("rest", f"{p}+", ""))
    windows = F.when(
        F.size("ws") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("ws") - WINDOW), lambda i: F.xxhash64(*[F.col("ws")[i + k] for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.lit(None).cast("array<string>")
    for lang, words in COMMON.items():
        own = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(own)
    d = d.select(
        "row", "doc_id", "lang",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("rest").alias("n_rest"),
        *[without(p).cast("long").alias(f"n_{k}") for k, p in CLASSES.items()],
        F.filter("ws", lambda w: w.isin(every)).alias("common"),
        own.alias("own"),
        windows.alias("windows"),
    )
    d = d.withColumn("ordered", F.sort_array("windows"))
    again = F.filter("ordered", lambda x, i: (i > 0) & (x == F.get("ordered", i - 1)))
    d = d.withColumn("repeats", F.size(again) > 0).drop("ordered")
    # only texts with a repeated window come to what follows; places of repeated windows, in order
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.col("repeats"), placed)).drop("windows")
    twice = F.filter(
        "placed",
        lambda x, i: F.coalesce((i > 0) & (F.get("placed", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("placed", i + 1)["h"] == x["h"], F.lit(False)),
    )
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    spans = F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda n, of: F.when(of > 0, F.round(n / of, 3)).otherwise(0.0)
    chars, words = F.col("word_chars"), F.col("n_words")
    judged = [F.col(f"n_{k}") for k in CLASSES]
    known = judged[0]
    for n in judged[1:]:
        known = known + n
    hist = [*[share(n, chars) for n in judged], share(F.col("n_rest") - known, chars), share(chars - F.col("n_rest"), chars)]
    hits = [_hits(k) for k in range(N_WORD - 1)]
    d = d.select(
        "row", "doc_id", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        *[h.alias(f"c{k}") for k, h in enumerate(hist)],
        *[F.when(F.col("own").isNotNull(), share(h, words)).alias(f"w{k}") for k, h in enumerate(hits)],
    )
    total = F.col("w0")
    for k in range(1, N_WORD - 1):
        total = total + F.col(f"w{k}")
    d = d.withColumn(f"w{N_WORD - 1}", F.round(F.greatest(1.0 - total, F.lit(0.0)), 3))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares that are first made to sum to one.

    Null if either sums to 0 or has a null.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    scaled = lambda x: F.transform(x, lambda v: v / F.when(total(x) > 0, total(x)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).when(x.isNotNull(), 0.0)
    both = F.zip_with(scaled(p), scaled(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    half = total(both) / 2
    return F.when(half.isNotNull(), F.sqrt(F.greatest(half, F.lit(0.0))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_divergence, word_divergence (null where not judged) and kept.

    A null or empty text has zero counts and fails the base rules.  A null or unknown language is judged
    by characters against the documents of the same language value, by words not at all.  A text of any
    length is judged as a whole; its words and windows are arrays in one row.  Repeated rows and null ids
    are kept as rows of their own.  Other columns aren't read.
    """
    return _judged(cut(counts(docs, id_col, text_col, lang_col).drop("row"), "counts")).drop("lang")


def passed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.  Rows are written with their
    counts once and not shuffled."""
    return _judged(cut(counts(docs, id_col, text_col, lang_col), "counts")).where("kept").select("row.*")


def _judged(d: DataFrame) -> DataFrame:
    """``counts`` with the verdict; ``d`` is read twice."""
    sides = [("c", N_CHAR, LEAST_CHAR_WORDS, MOST_CHAR), ("w", N_WORD, LEAST_WORD_WORDS, MOST_WORD)]
    medians = [
        F.percentile(F.when(~F.col("base_failed") & (F.col("n_words") >= least), F.col(f"{side}{k}")), 0.5).alias(f"{side}{k}_ref")
        for side, n, least, _ in sides
        for k in range(n)
    ]
    refs = cut(d.groupBy(F.col("lang").alias("ref_lang")).agg(*medians), "references")
    columns = [c for c in d.columns if c not in {f"{side}{k}" for side, n, _, _ in sides for k in range(n)}]
    d = d.join(refs, d.lang.eqNullSafe(refs.ref_lang), "left")
    far = {
        side: F.when(F.col("n_words") >= least, divergence(F.array(*[f"{side}{k}" for k in range(n)]), F.array(*[f"{side}{k}_ref" for k in range(n)])))
        for side, n, least, _ in sides
    }
    d = d.select(*columns, far["c"].alias("char_divergence"), far["w"].alias("word_divergence"))
    slack = SLACK / F.greatest("n_words", F.lit(1))
    within = F.lit(True)
    for side, _, _, most in sides:
        within = within & F.coalesce(F.col({"c": "char_divergence", "w": "word_divergence"}[side]) <= most + slack, F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & within)
