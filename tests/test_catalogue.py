"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from quarry import catalogue
from quarry.sources import scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    res = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(res.columns)
    at = [res.columns.index(c) for c in cols]
    assert cols == sorted(df.columns)
    scratch.clear(spark)
    assert sorted(map(repr, got)) == sorted(map(repr, [tuple(norm(r[i]) for i in at) for r in res.fetchall()]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir("/root/testdata")


def test_postings_are_made_for_those_who_search(spark, sf_dir, monkeypatch):
    """A query that reads the chunks alone makes no postings, and one index serves both."""
    monkeypatch.setattr(catalogue.Tables, "_last", None)
    t = catalogue.Tables(spark, sf_dir)
    assert catalogue.QUERIES["s8_s10_sorted_layout"](spark, sf_dir).count() and catalogue.Tables._last[2] is None
    ch = t.indexed()
    assert t.corpus()[0] is ch and t.corpus()[1] is catalogue.Tables._last[2] and t.corpus()[1].segments
