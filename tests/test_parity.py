"""Queries against their SQL in another engine, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from rasterloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in plans.oracle_sql()]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, sf, con):
    found = plans.queries()[name](spark, sf)
    answer = con.execute(plans.oracle_sql()[name])
    columns = sorted(c[0] for c in answer.description)
    assert sorted(found.columns) == columns
    place = {c[0]: i for i, c in enumerate(answer.description)}
    want = sorted((tuple(r[place[c]] for c in columns) for r in answer.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in plans.oracle_sql()])
def test_query_without_sql_runs(name, spark, sf):
    assert plans.queries()[name](spark, sf).count() > 0
