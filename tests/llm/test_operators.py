"""Corpus operators against brute force on small tables with odd rows: nulls, empty, white and long texts,
repeated rows, ties, empty tables, and columns with clashing names."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.llm import bloom, bpe, classifier, components, decontaminate, hashing, neardup, repeats, rules, sharding, unigram, warc
from vicinal.llm.queries import vocabulary

WHITE = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{k % 997}x{k // 7}" for k in range(20_000))
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one two", "en"), (5, "One TWO", "de"), (6, LONG, "en"), (7, LONG + " end", "xx"),
    (8, "É a b c d é f g", "fr"), (8, "É a b c d é f g", "fr"), (None, "a row without an id, of some words", "en"), (10, "x\x1cy\u00a0z \U0001f600", "es"),
]
SCHEMA = "doc_id long, text string, lang string, kept string, component_id string, node long, n string, label string, gone long, row string, pattern string, spans int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", "c", 1, "n", "l", 2, "r", "p", 3) for i, t, lang in rows], SCHEMA)


def odd(spark):
    return table(spark, ODD)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(WHITE, text or "")


# ---- hashing and near duplicates ----


def test_word_hashes_see_words_only():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\t\n  漢") for _ in range(rng.randrange(60))) for _ in range(400)] + ["x" * 3_000_000 + " y", "a b " * 600_000]
    seen = {}
    for t in texts:
        ws, hs = words_of(t), hashing.word_hashes(t.encode())
        assert len(ws) == len(hs)
        for w, h in zip(ws[:2000], hs[:2000].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 20, 500, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: max(1, 3 * n // 4)], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])
        sa, sb = hashing.sketch(a, 128), hashing.sketch(b, 128)
        assert (sa != hashing._EMPTY).all()
        assert np.array_equal(sa, hashing.sketch(a[::-1].copy(), 128))
        if n >= 20:
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((sa == sb).mean() - true) < 0.2


def brute_classes(rows):
    sets = []
    for _, t in rows:
        ws = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            k = len(sets[x] & sets[y])
            if k and 100 * k >= 75 * len(sets[x] | sets[y]):
                up[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[top(x)] = min(i, least.get(top(x), i))
    return {i: (len(sets[x]), least[top(x)]) for x, (i, _) in enumerate(rows)}


def test_near_duplicates_like_brute_force(spark, monkeypatch):
    """A large group around one base, of which many pairs are just over or under the threshold."""
    monkeypatch.setattr(neardup, "LEFT_DOCS", 8)
    monkeypatch.setattr(neardup, "RIGHT_DOCS", 16)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randrange(1, 9)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(ws)))
    rows += [(2000 + i, " ".join(f"z{rng.randrange(40)}" for _ in range(30))) for i in range(40)]
    rows += [(3000, "a b"), (3001, "A  B"), (3002, ""), (3003, " "), (3004, rows[0][1])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_one_id_on_several_texts(spark):
    """Every row stands for itself, in SQL too; a filter that lets all through changes nothing."""
    text = lambda k, end="": " ".join(f"t{k}w{j}" for j in range(40)) + end
    rows = [(3, text(1)), (5, text(1, " e")), (5, text(2)), (9, text(2, " f")), (12, text(3)), (12, text(1, " g")), (12, text(1, " g")), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(3, 36, 3), (5, 37, 3), (5, 36, 5), (9, 37, 5), (12, 36, 12), (12, 37, 3), (12, 37, 3), (1, 0, 1)])
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()) == want
    left = neardup.without_near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(3, text(1)), (5, text(2)), (12, text(3)), (1, "")])


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_filter_of_keys(spark, monkeypatch, words):
    monkeypatch.setattr(bloom, "WORDS", words)
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("k")))
    found = bloom.flagged(spark.range(3000).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id"))), bloom.marks(keys, "k"), "id")
    missed = found.where("not f_maybe and (id is null or id % 3 = 0)")
    assert missed.isEmpty() and found.where("f_maybe").count() <= (3001 if words == 1 else 1030)


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[3]["component_id"] == 3 and by[5]["component_id"] == 4 and by[7]["component_id"] == 6
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(chain).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# ---- quality ----


def test_rules_base_counts(spark):
    rows = [*ODD, (20, "a b c d e f a b c d e f g h", "en"), (21, "same same same same same same same", "en"), (22, "l1 x\n\nl1 x\n \nl2\nl1 x", "de"), (23, "# * $ %& | < > ~", "en")]
    got = {r["doc_id"]: r for r in rules.quality_rules(table(spark, rows)).collect()}
    for i, t, _ in rows:
        ws = words_of(t)
        runs = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {k + j for k in range(len(ws) - 4) if runs[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(WHITE, x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    assert rules.quality_rules(empty(spark)).count() == 0


def test_divergence(spark):
    d = lambda p, q: spark.range(1).select(rules.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert d([0.5, 0.5], [1.0, 1.0]) == pytest.approx(0)
    assert d([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1)
    assert d([0.0, 0.0], [0.0, 1.0]) is None


def test_rules_and_classifier_on_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    for found in (rules.quality_rules(docs).where("n_words >= 20"), classifier.classified(docs)):
        rows = found.select("doc_id", "kept").join(labels, "doc_id").collect()
        bad = [r["kept"] for r in rows if not r["quality"]]
        good = [r["kept"] for r in rows if r["quality"]]
        assert sum(bad) / len(bad) <= 0.12 and sum(good) / len(good) >= 0.95


def test_classifier_of_odd_rows(spark):
    got = classifier.classified(odd(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["score"] for r in got}[1] == 0.0
    assert classifier.classified(empty(spark)).count() == 0


def test_scores_like_brute_force(spark, monkeypatch):
    """Votes, posteriors and scores computed one by one, from the weights that the operator fits."""
    fitted = []
    fit = classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda rows, labels: fitted.append((rows, labels, fit(rows, labels))) or fitted[-1][2])
    rng = random.Random(4)
    texts = ["", None] + [" ".join(rng.choice(["the", "of", "River", "STONE", "##", "a1b2", "green.", "!!", "und"]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    got = classifier.classified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    (rows, labels, (weights, bias)), patterns = fitted[0], [tuple(classifier.votes(t)) for t in texts]
    assert len(rows) == len(texts) and sum(len(r[0]) > 0 for r in rows) == len(texts) - 2
    # expectation and maximisation, pattern by pattern and labeller by labeller
    seen = sorted(set(patterns), key=lambda p: sum((v + 1) * 3**k for k, v in enumerate(p)))
    n = collections.Counter(patterns)
    good = {p: 0.1 if -1 in p else 0.9 for p in seen}
    for _ in range(200):
        like = []
        for of in (lambda p: 1 - good[p], lambda p: good[p]):
            weight = {p: n[p] * of(p) for p in seen}
            total = sum(weight.values())
            rate = [{v: (sum(w for p, w in weight.items() if p[k] == v) + 1) / (total + 3) for v in (-1, 0, 1)} for k in range(len(classifier.LABELLERS))]
            like.append({p: (total + 1) / (len(texts) + 2) * np.prod([rate[k][v] for k, v in enumerate(p)]) for p in seen})
        new = {p: like[1][p] / (like[0][p] + like[1][p]) for p in seen}
        if max(abs(new[p] - good[p]) for p in seen) < 1e-9:
            break
        good = new
    # the good class has more good votes
    mean = [sum(n[p] * w * sum(p) for p, w in part.items()) / sum(n[p] * w for p, w in part.items()) for part in ({p: 1 - g for p, g in good.items()}, good)]
    if mean[1] < mean[0]:
        good = {p: 1 - g for p, g in good.items()}
    for r in got:
        own = classifier.features(texts[r["doc_id"]])
        z = bias + 3 * sum(float(weights[k]) for k in own) / len(own) if len(own) else None
        assert r["weak_score"] == pytest.approx(good[patterns[r["doc_id"]]], abs=1e-6)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)) if len(own) else 0.0, abs=1e-5) and r["kept"] == (r["score"] >= 0.5)


def test_sample_of_a_large_or_repeated_table(spark):
    """A share far under one in a million still draws by 63 bits, and a table of one repeated text is sampled."""
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    assert len(classifier._sampled(docs.join(spark.range(2000)).select("doc_id", "text"), 10**13, 6000, 10**6)) == 1
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), "id").alias("text"))
    assert 300 < len(classifier._sampled(many, 5000, 400, 10**6)) < 500
    assert 20 <= len(classifier._sampled(many, 5000, 400, 300)) <= 60


def test_expectation_maximisation_finds_good_labellers():
    """Posteriors near those of the true vote rates."""
    rng = np.random.default_rng(0)
    n, hit, false = 20_000, np.array([0.7, 0.6, 0.5]), np.array([0.01, 0.02, 0.01])
    truth = rng.random(n) < 0.8
    votes = -(rng.random((n, 3)) < np.where(truth[:, None], false, hit)).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good = classifier.expectation_maximisation(patterns, counts.astype(float))
    a = 0.8 * np.where(patterns < 0, false, 1 - false).prod(axis=1)
    b = 0.2 * np.where(patterns < 0, hit, 1 - hit).prod(axis=1)
    assert np.average(np.abs(good - a / (a + b)), weights=counts) < 0.02


# ---- sharding ----


def brute_shards(rows, shards):
    """A ring of one list: every row to the next node's shard, and what is over its share on to the next with room."""
    circle = sorted((int.from_bytes(hashlib.sha1(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(sharding.NODES))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = collections.defaultdict(list)
    for at, part, row in rows:
        arc = next((k for k, (p, _) in enumerate(circle) if p >= at), 0)
        arcs[arc].append((part, at, row))
    shard_of, over = collections.defaultdict(list), []
    for arc in sorted(arcs):
        for part, at, row in sorted(arcs[arc]):
            if len(shard_of[circle[arc][1]]) < room[circle[arc][1]]:
                shard_of[circle[arc][1]].append(row)
            else:
                over.append((arc, row))
    for arc, row in over:
        while len(shard_of[circle[arc][1]]) >= room[circle[arc][1]]:
            arc = (arc + 1) % len(circle)
        shard_of[circle[arc][1]].append(row)
    return sorted((*row, s, k) for s, own in shard_of.items() for k, row in enumerate(own))


@pytest.mark.parametrize("alike", [7, sharding.ALIKE])
def test_shards_like_brute_force(spark, monkeypatch, alike):
    """Also an id on many texts and a row on many places; dealt over files in two ways."""
    monkeypatch.setattr(sharding, "ALIKE", alike)
    rows = [(k, f"text {k}") for k in range(300)] + [(7, "again")] * 200 + [(8, f"other {k}") for k in range(200)] + [(-5, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 16L as size", "crc32(cast(coalesce(text, '') as binary)) as crc")
    placed = own.selectExpr("xxhash64(doc_id) as at", f"pmod(xxhash64('part', doc_id, size, crc), {sharding.PARTS}) as part", "doc_id", "size", "crc").collect()
    for shards in (3, 40):
        want = brute_shards([(r["at"], r["part"], (r["doc_id"], r["size"], r["crc"])) for r in placed], shards)
        for dealt in (docs, docs.repartition(13, F.rand(1))):
            got = sharding.assign_shards(dealt, shards).collect()
            assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    assert all(r["text_crc32"] == zlib.crc32((dict(rows)[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] not in (7, 8, 9))
    sizes = collections.Counter(x[3] for x in want).values()
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 40


def test_shards_of_odd_rows(spark):
    assert sharding.assign_shards(empty(spark), 40).count() == 0
    got = sharding.assign_shards(odd(spark), 3).collect()
    assert len(got) == len(ODD) and all(r["size"] == len((t or "").encode()) + 16 for r in got for i, t, _ in ODD if i == r["doc_id"])


def test_shards_of_a_hot_id(spark):
    docs = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign_shards(docs, 7)
    rows = got.groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    assert len(rows) == 7 and max(r["n"] for r in rows) - min(r["n"] for r in rows) <= 1
    assert all(r["n"] == r["slots"] == r["last"] + 1 for r in rows)


def test_a_new_shard_moves_few(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    by = {n: {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, n).collect()} for n in (20, 21, 40, 41)}
    moved = lambda a, b: sum(by[a][k] != by[b][k] for k in by[a]) / len(by[a])
    assert moved(20, 21) < 0.10 and moved(40, 41) < 0.08


# ---- archives ----


def test_archive(spark, tmp_path):
    rows = [(5, "u5", "same é"), (3, "u3\r\nX: y", "same é"), (9, None, None), (8, "u8", ""), (4, "u4", "a\r\n\r\nb"), (4, "u4", "a\r\n\r\nb"), (None, "n", "same é"), (6, "u6", "x" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, record string, sha256 long")
    got = warc.archived(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    first = {"same é": 3, "": 8, "a\r\n\r\nb": 4, "x" * 300_000: 6}
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(h.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h] == r["page_id"] else ("revisit", first[h]))
    records = {r["page_id"]: bytes(r["record"]) for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    head, body = records[3].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == "same é\r\n\r\n".encode()
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 4
    assert warc.archived(pages.limit(0)).count() == 0


# ---- very long texts ----


def test_texts_of_megabytes(spark):
    """One of 4 MB in many words, one of 2 MB without a space: whole, in every operator with a Python kernel."""
    many, none = " ".join(f"word{k % 5000} t{k}" for k in range(300_000)), "ab" * 1_000_000
    passage = "a passage that the benchmark holds and that stands at the very end of a very long document, word for word"
    docs = spark.createDataFrame([(1, many + " " + passage), (2, none), (3, "short text")], "doc_id long, text string").repartition(3, "doc_id")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    hit = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(docs, items).collect()}
    assert hit == {1: [7], 2: [], 3: []}
    assert all(r["score"] >= 0 for r in classifier.classified(docs).collect())
    assert {r["doc_id"]: r["n_shingles"] for r in neardup.near_duplicates(docs).collect()} == {1: len(words_of(many + passage)) - 3, 2: 1, 3: 1}
    coded = {r["doc_id"]: r["n_tokens"] for r in bpe.bpe_codes(docs, vocabulary("word_bpe_49k.json")).collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert coded[1] > 600_000 and coded[2] > 100_000 and counted[1] > 600_000 and counted[2] > 100_000


# ---- decontamination ----


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("places", [1, decontaminate.PART_PLACES])
def test_regions_like_full_alignment(monkeypatch, places):
    monkeypatch.setattr(decontaminate, "PART_PLACES", places)
    rng = random.Random(3)
    for _ in range(120):
        item = "".join(rng.choice("abcd efgh") for _ in range(rng.choice((40, 80, 130))))
        text = list(item)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(text))
            text[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        text = "q" * rng.randrange(60) + "".join(text) + "r" * rng.randrange(60)
        index = decontaminate.BenchmarkIndex([(1, w) for w in decontaminate.windows_of(item)])
        want = any(edits(w, decontaminate.normal(text)) <= e for (_, w), e in zip(index.windows, index.edits.tolist(), strict=True))
        assert bool(index.regions(text)) == want


def test_contamination(spark, monkeypatch):
    passage = "the quick onerous brown fox has jumped over nineteen lazy dogs and then went home to sleep until the morning came again"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "short"), (None, passage.upper()), (6, "zebra " * 30)], "item_id long, text string")
    rows = [*ODD, (30, "before. " + passage.replace("lazy", "lzy").title() + " after", "en"), (31, "clean words " * 20, "en"), (32, passage[:60], "en")]
    for block in (decontaminate.BLOCK_WINDOWS, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        left = decontaminate.uncontaminated(table(spark, rows), items)
        assert left.columns == odd(spark).columns and sorted(left.collect(), key=repr) == sorted((r for r in table(spark, rows).collect() if r["doc_id"] != 30), key=repr)
        got = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, rows), items).collect()}
        assert [i for i, r in got.items() if not r["kept"]] == [30]
        assert [x for x in got[30]["item_ids"] if x] == [1]
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert decontaminate.contamination(odd(spark), items.limit(0)).where("not kept").isEmpty()


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Who is Ann?"), (2, "forty two"), (3, "?!"), (4, "forty two"), (5, " ")], "item_id long, text string")
    texts = ["so who  is\nANN?\u201d", "who is anne?", "it is Forty Two.", "forty twos", "a forty-two", "what?!", "what ?! no", "", "xforty two", "forty two"]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(table(spark, [(k, t, "en") for k, t in enumerate(texts)]), items).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: [], 6: [3], 7: [], 8: [], 9: [2]}
    index = decontaminate.BenchmarkIndex([(i, w) for i, t in ((1, "forty two"), (2, "word " * 20)) for w in decontaminate.windows_of(t)])
    assert index.regions("So forty two " + "word " * 20)[0] == (1, 3, 12, 0) and {r[0] for r in index.regions("word " * 20)} == {2}


# ---- tokens ----

ALPHABET = list("abcABC  \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u3000ΣσςİıßÉ\u0301한글漢字👩\u200d'’`sStTrReEvVlLdD0129٣²<|>!?.,#%") + ["<|endoftext|>", "'s", "'ll", "ΑΣ ", "Å", " the", "▁"]


def fuzz(n=3000):
    rng = random.Random(8)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)] + ["a" * 3000, "the" * 2000]


def test_bpe_like_the_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), bpe.BytePairCodec(vocabulary("word_bpe_49k.json"))
    for text in fuzz():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == (" ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False)), text


def test_code_points_like_the_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), bpe.BytePairCodec(vocabulary("word_bpe_49k.json"))
    new = {c for a, b, *_ in bpe.LOWER_17 + bpe.LETTERS_16 + bpe.NUMBERS_16 for c in range(a - 1, b + 2)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 13 == 5 or c < 0x600 or c in new)]
    for k in range(0, len(points), 5000):  # letters, numbers and others part differently
        text = " ".join(f"b{chr(c)}!" for c in points[k : k + 5000])
        assert ours.encode(text)[0] == " ".join(map(str, theirs.encode(text, add_special_tokens=False).ids)), k


def test_bpe_rows(spark):
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.bpe_codes(odd(spark), path)
    got = coded.collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[3]["decoded"] == ""
    back = {r["doc_id"]: r["decoded"] for r in bpe.bpe_texts(coded, path).collect()}
    assert back == {i: r["decoded"] for i, r in by.items()}
    assert bpe.bpe_codes(empty(spark), path).count() == 0


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_counts_like_the_library(with_bytes):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [p for p in unigram.read_pieces(vocabulary("piece_bpe_32k.model")) if with_bytes or not p[0].startswith("<0x")]
    theirs, ours = Tokenizer(models.Unigram(pieces, 0, with_bytes)), unigram.UnigramCounter(pieces)
    theirs.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for text in fuzz():
        assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids), text


def test_unigram_ties():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    from tokenizers import Tokenizer, models

    theirs = Tokenizer(models.Unigram(pieces, 0, False))
    for word in ("▁ab", "▁abab", "▁ba", "▁xxab", "▁axxb"):
        assert unigram.UnigramCounter(pieces).word(word) == len(theirs.encode(word).ids), word


def test_unigram_rows(spark):
    path = vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(odd(spark), path).collect()}
    assert got[1] == got[2] == 0 and got[6] > 20_000
    assert unigram.token_counts(empty(spark), path).count() == 0


# ---- repeats ----


def brute_repeats(rows, split, joint, shapes):
    trim = lambda x: x.rstrip(" \t\n\x0b\f\r")
    spans = collections.defaultdict(list)
    units = {i: split(t or "") for i, t in rows}
    worded = {i: [k for k, x in enumerate(u) if trim(x)] for i, u in units.items()}
    for i, _ in sorted(rows):
        for n, least in shapes:
            for k in range(len(worded[i]) - n + 1):
                run = tuple(trim(units[i][worded[i][k + j]]) for j in range(n))
                if sum(map(len, run)) >= least:
                    spans[n, run].append((i, k))
    gone, several = collections.defaultdict(set), collections.defaultdict(set)
    for (n, _), at in spans.items():
        for i, k in sorted(set(at))[1:]:
            gone[i] |= {worded[i][k + j] for j in range(n)}
            several[i] |= {worded[i][k + j] for j in range(n) if n > 1}
    return {i: (joint.join(x for k, x in enumerate(u) if k not in gone[i]), len(gone[i]), len(gone[i] - several[i])) for i, u in units.items()}


def test_line_dedup_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "", "  ", "e"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_single"]) for r in repeats.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows, lambda t: t.split("\n"), "\n", ((3, 1),))


def test_substring_dedup_like_brute_force(spark):
    rng = random.Random(6)
    bank = ["It is.", "A longer sentence stands here now!", "What, then, of the third of them?", "No end", "One more\nline.", "And a very long sentence " + "with many words " * 9 + "in it.", "One " + "as long as a passage " * 14 + "is."]
    rows = [(i, " ".join(rng.choice(bank) for _ in range(rng.randrange(9))) + rng.choice(["", " ", "\n"])) for i in range(60)]
    mark = lambda t: [x for x in re.sub(r"([.!?][ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*)", "\\1\x1e", t).split("\x1e") if x]
    for extra in (repeats.LONG_SENTENCE, ()):
        found = repeats.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), extra=extra).collect()
        got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_single"]) for r in found}
        assert got == brute_repeats(rows, mark, "", repeats.SENTENCE_RUNS + extra)
        assert any(r["n_single"] for r in found) == bool(extra)


@pytest.mark.parametrize("operator", [repeats.line_dedup, repeats.substring_dedup])
def test_repeats_of_odd_rows(spark, operator):
    got = operator(odd(spark)).select("row.*", F.col("text").alias("new"), "n_removed").collect()
    assert len(got) == len(ODD) and got[0].__fields__[: len(SCHEMA.split(","))] == [x.split()[0] for x in SCHEMA.split(", ")]
    assert all(r["new"] == r["text"] and r["n_removed"] == 0 for r in got)
    assert operator(empty(spark)).count() == 0


def test_a_marked_text_is_one_sentence(spark):
    text = f"One. Two.{repeats.MARK} Three. " * 4
    r = repeats.substring_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["text"] == text and r["n_units"] == 1


def test_sql_is_named_after_queries():
    from vicinal.llm.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and json.dumps(sorted(QUERIES))
