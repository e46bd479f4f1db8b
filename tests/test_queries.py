"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tests.conftest import DATA
from vicinal.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(([plain(r[k]) for k in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, cur.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and abs(u - v) <= 1e-4) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_of_the_approximate_graph(spark, scale):
    """500 and 2,000 points."""
    assert QUERIES["approx_knn_recall"](spark, f"/root/testdata/{scale}").first()["recall"] >= 0.9


def test_layout_query_runs_the_whole_job(spark, monkeypatch):
    from vicinal.operators import layout

    monkeypatch.setattr(layout, "embed", lambda spark, points, config: config)
    assert QUERIES["embed_2d"](spark, DATA) == layout.Config()


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "HAS_LLM", False)
    monkeypatch.setattr(e, "HAS_PIPELINE", False)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)
