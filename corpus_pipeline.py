"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE; each stage an operator's decisions.

Every stage takes (spark, docs, sf_dir) and gives the columns of ``docs``, the last one tokens instead.
A stage works on rows, whatever their ids: nulls, repeated ids and repeated rows are rows of their own, and
only near-dedup makes repeated rows one.  An empty table gives an empty one, texts are worked on whole,
however long, and columns beyond those of ``documents`` go along.  ``run`` writes each stage's rows to the shared folder and reads them again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.bpe import bpe_codes
from vicinal.llm.decontaminate import uncontaminated
from vicinal.llm.neardup import without_near_duplicates
from vicinal.llm.queries import vocabulary
from vicinal.llm.repeats import line_dedup
from vicinal.llm.rules import passed
from vicinal.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return passed(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, with them n_chars, and a document of which no word is left."""
    found = line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the least id.

    Every row stands for itself, so one id on different texts is as several documents.  A row without an id
    or a word stays.
    """
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text."""
    return bpe_codes(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", tokens),
]

#: The last stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
