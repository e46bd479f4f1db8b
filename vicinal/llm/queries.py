"""One query for each operator, over its whole table with production parameters, and the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import rules
from vicinal.llm.bpe import bpe_codes
from vicinal.llm.classifier import classified
from vicinal.llm.decontaminate import contamination
from vicinal.llm.neardup import near_duplicates
from vicinal.llm.repeats import LONG_SENTENCE, SENTENCE_RUNS, line_dedup, substring_dedup
from vicinal.llm.sharding import assign_shards
from vicinal.llm.unigram import token_counts
from vicinal.llm.warc import archived


def vocabulary(name: str) -> str:
    """Where the public tokenizer file of that name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(_read(spark, sf_dir, "documents"))
    return found.drop("char_divergence", "word_divergence")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_read(spark, sf_dir, "documents"), 40)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codes(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_sentences"), "n_removed", "n_single", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_classifier, op3_quality_rules, op4_sharding, op5_warc,
        op6_decontamination, op7_bpe, op8_line_dedup, op9_token_counts, op10_substring_dedup,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _op3() -> str:
    """Counts, medians of shares and divergences as in ``rules``, from the same fixed values."""
    chars, words = range(rules.N_CHAR), range(rules.N_WORD)
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in ws)}]" for lang, ws in rules.COMMON.items())
    classes = ", ".join(f"length(rest) - length(regexp_replace(rest, '{p}+', '', 'g')) AS n_{k}" for k, p in rules.CLASSES.items())
    known = " + ".join(f"n_{k}" for k in rules.CLASSES)
    hist = [f"n_{k}" for k in rules.CLASSES] + [f"length(rest) - ({known})", "word_chars - length(rest)"]
    share = lambda n, of: f"CASE WHEN {of} > 0 THEN round(({n})::DOUBLE / {of}, 3) ELSE 0.0 END"
    cs = ", ".join(f"{share(h, 'word_chars')} AS c{k}" for k, h in enumerate(hist))
    hits = [f"len(list_filter(ws, lambda x: x = own[{k + 1}]))" for k in words[:-1]]
    ws = ", ".join(f"CASE WHEN own IS NOT NULL THEN {share(h, 'n_words')} END AS w{k}" for k, h in enumerate(hits))
    rest = " + ".join(f"w{k}" for k in words[:-1])

    def medians(side: str, n: range, least: int) -> str:
        return ", ".join(f"quantile_cont({side}{k}, 0.5) FILTER (WHERE NOT base_failed AND n_words >= {least}) AS {side}{k}_ref" for k in n)

    def divergence(side: str, n: range) -> str:
        p, q = ([f"{side}{k}{end}" for k in n] for end in ("", "_ref"))
        sp, sq = "(" + " + ".join(p) + ")", "(" + " + ".join(q) + ")"
        parts = []
        for x, y in zip(p, q, strict=True):
            a, b = f"({x} / nullif({sp}, 0))", f"({y} / nullif({sq}, 0))"
            parts += [f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({a} + {b}) / 2)) WHEN {v} IS NOT NULL THEN 0.0 END" for v in (a, b)]
        return "sqrt(greatest((" + " + ".join(parts) + ") / 2, 0.0))"

    within = " AND ".join(
        f"coalesce(n_words < {least} OR {divergence(side, n)} <= {most} + {rules.SLACK} / greatest(n_words, 1), true)"
        for side, n, least, most in (("c", chars, rules.LEAST_CHAR_WORDS, rules.MOST_CHAR), ("w", words, rules.LEAST_WORD_WORDS, rules.MOST_WORD))
    )
    return rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS ws,
    regexp_replace(coalesce(text, ''), '[\p{{Ll}}\x20\x09-\x0D]+', '', 'g') AS rest,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE lang {lists} END AS own FROM documents),
u AS (SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, {classes} FROM t),
g AS (SELECT doc_id, unnest(range(1, n_words - 3)) AS i, unnest(list_transform(range(1, n_words - 3), lambda i: ws[i:i + 4])) AS win FROM u WHERE n_words >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, range(5) x(j) WHERE n > 1 GROUP BY doc_id),
v AS (SELECT u.doc_id, lang, n_words, word_chars, n_symbol, n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, {cs}, {ws} FROM u LEFT JOIN k USING (doc_id)),
x AS (SELECT *, round(greatest(1.0 - ({rest}), 0.0), 3) AS w{rules.N_WORD - 1}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v),
f AS (SELECT lang AS ref_lang, {medians("c", chars, rules.LEAST_CHAR_WORDS)}, {medians("w", words, rules.LEAST_WORD_WORDS)} FROM x GROUP BY lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM x LEFT JOIN f ON lang IS NOT DISTINCT FROM ref_lang
"""


_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(html), 1 + 5 * (k // 4)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


def _repeats(split: str, joint: str, shapes: tuple[tuple[int, int], ...], count: str, single: str = "") -> str:
    """Windows by their very text, first occurrences by order, and what the others cover."""
    trim = r"rtrim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    windows = " UNION ALL ".join(
        f"SELECT doc_id, i, {w} AS w, list_transform(us[i:i + {w - 1}], lambda x: x.s) AS win FROM "
        f"(SELECT doc_id, us, unnest(range(1, len(us) - {w - 2})) AS i FROM n WHERE len(us) >= {w}) "
        f"WHERE list_sum(list_transform(us[i:i + {w - 1}], lambda x: length(x.s))) >= {least}"
        for w, least in shapes
    )
    return rf"""
WITH u AS (SELECT doc_id, text, {split} AS units FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(range(1, len(units) + 1), lambda k: {{'k': k, 's': {trim.format("units[k]")}}}), lambda x: x.s <> '') AS us FROM u),
v AS ({windows}),
o AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY w, win ORDER BY doc_id, i) AS r FROM v),
g AS (SELECT doc_id, i, max(w) AS w FROM (SELECT doc_id, w, unnest(range(i, i + w)) AS i FROM o WHERE r > 1) GROUP BY doc_id, i),
k AS (SELECT g.doc_id, list(n.us[g.i].k) AS gone, count(*) FILTER (WHERE g.w = 1) AS alone FROM g JOIN n USING (doc_id) GROUP BY g.doc_id)
SELECT u.doc_id, len(units)::BIGINT AS {count}, coalesce(len(gone), 0)::BIGINT AS n_removed, {single}
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(units) + 1), lambda j: NOT list_contains(gone, j)), lambda j: units[j]), {joint}) END AS text
FROM u LEFT JOIN k USING (doc_id)
"""


_SENTENCES = (
    r"list_filter(string_split(regexp_replace(text, '([.!?][ \t\n\x0B\f\r]+|\n[ \t\n\x0B\f\r]*)', '\1' || chr(57344) || chr(57345), 'g'), "
    r"chr(57344) || chr(57345)), lambda x: x <> '')"
)

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": _OP1,
    "op3_quality_rules": _op3(),
    "op5_warc": _OP5,
    "op8_line_dedup": _repeats("string_split(text, chr(10))", "chr(10)", ((3, 1),), "n_lines"),
    "op10_substring_dedup": _repeats(_SENTENCES, "''", SENTENCE_RUNS + LONG_SENTENCE, "n_sentences", "coalesce(alone, 0)::BIGINT AS n_single,"),
}
