"""Queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.test_queries import rows
from vicinal.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cur.fetchall())


def test_bpe_query_like_the_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    from vicinal.llm.queries import vocabulary

    theirs = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, DATA).collect():
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_benchmark_passages_are_found(spark):
    from vicinal.llm.decontaminate import normal

    items = [normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: normal(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {i for i, t in texts.items() if any(x in t for x in items)}
    assert {r["doc_id"] for r in QUERIES["op6_decontamination"](spark, DATA).collect() if not r["kept"]} == want


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DATA).cache()
        assert out.columns == columns, name
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert set(after) == {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, DATA).collect() if r["kept"]}
        elif name == "line_dedup":
            assert all(len(after[i]) <= len(before[i]) for i in after)
        else:
            assert all(after[i] == before[i] for i in after)
        kept = out
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert tokens.count() == kept.count() and tokens.where("n_tokens = 0").count() == kept.where("trim(text) = ''").count()


def test_stages_of_odd_rows(spark):
    from tests.llm.test_operators import ODD

    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() <= len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.near_dedup(spark, docs, DATA).where("doc_id = 8").count() == 1


def brute_pipeline(rows, items):
    """(doc_id, ids, decoded) by SQL, plain loops and the tokenizer library; ``rows``: (doc_id, text, lang)."""
    from tokenizers import Tokenizer

    from tests.llm import test_operators as t
    from vicinal.llm import decontaminate
    from vicinal.llm.queries import vocabulary

    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, text, lang) for k, (_, text, lang) in enumerate(rows)])
    cur = duck.execute(ORACLE_SQL["op3_quality_rules"])
    at = [d[0] for d in cur.description].index
    good = {r[at("doc_id")] for r in cur.fetchall() if r[at("kept")]}
    docs = [(i, text) for k, (i, text, _) in enumerate(rows) if k in good]
    new = t.brute_repeats([r for r in docs if r[0] is not None], lambda x: x.split("\n"), "\n", ((3, 1),))
    docs = [(i, text if i is None else new[i][0]) for i, text in docs if i is None or not new[i][1] or new[i][0].strip(" \t\n\x0b\f\r")]
    once = [r for k, r in enumerate(docs) if r[0] is None or r not in docs[:k]]
    classes = t.brute_classes([r for r in once if r[0] is not None])
    docs = [r for r in once if r[0] is None or classes[r[0]][1] == r[0]]
    windows = [(w, len(w) // decontaminate.CHARS_AN_EDIT) for x in items for w in decontaminate.windows_of(x)]
    docs = [(i, text) for i, text in docs if not any(t.edits(w, decontaminate.normal(text)) <= e for w, e in windows)]
    theirs = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coded = [(i, theirs.encode(text, add_special_tokens=False).ids) for i, text in docs]
    return [(i, " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False)) for i, ids in coded]


def test_run_like_brute_force(spark, tmp_path):
    """All five stages over documents of which some repeat, lose lines, are near copies or hold a passage."""
    taken = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 700").orderBy("doc_id").limit(45).collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in taken]
    plain = [text for _, text, lang in rows if lang == "en" and len(text) > 200]
    three = "a first line that stands in two\na second line of the three\nand a third one"
    passage = "The committee of the northern harbour agreed that the old lighthouse shall be lit again before the winter storms begin to blow"
    rows += [(9001, plain[0] + "\n" + three, "en"), (9002, plain[1] + "\n" + three + "\n" + plain[2], "en"), (9003, three + "\n" + three, "en")]
    rows += [(9004, " ".join(f"word{k}" for k in range(60)), "xx"), (9005, " ".join(f"word{k}" for k in range(58)), "xx"), (9004, " ".join(f"word{k}" for k in range(60)), "xx")]
    rows += [(9006, plain[3] + " " + passage.replace("storms", "storns"), "en"), (9007, plain[4] + " " + passage.upper() + " " + plain[5], "en"), (9008, plain[4] + " " + passage[:50], "en")]
    rows += [(None, plain[6] + " without an id", "en"), (None, plain[6] + " without an id", "en"), (9009, None, "en"), (9010, "", None), (9011, "one " * 40, "en")]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"
    spark.createDataFrame([(i, text, lang, "s", len(text or ""), "k", 1) for i, text, lang in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    want = brute_pipeline(rows, [passage])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = {i for i, _, _ in want}
    assert {9001, None} <= kept and not {9005, 9006, 9007, 9009, 9010, 9011} & kept
    assert sum(i is None for i, _, _ in want) == 2 and sum(i == 9004 for i, _, _ in want) == 1


def test_near_dedup_of_one_id_on_several_texts(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(2)), (2, text(1)), (2, text(3)), (2, text(3)), (3, text(4)), (0, text(4) + " end"), (None, text(1)), (None, text(1)), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=repr)
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (0, text(4) + " end"), (None, text(1)), (None, text(1)), (7, None), (8, "")]
    assert got == sorted(want, key=repr)
