"""Every query of the evidence engine against its SQL, over cases that have every kind of issue."""

from __future__ import annotations

import collections

import duckdb
import pytest

from siftline.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sql, name):
    want = sql.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    count = lambda rows: collections.Counter(tuple(map(repr, r)) for r in rows)
    assert count(got.select(*columns).collect()) == count(want.fetchall())


def test_made_cases_have_every_issue(sql):
    from siftline.plans.cases import _SCAM_SQL

    kinds = {k for (k,) in sql.execute(_SCAM_SQL + "SELECT DISTINCT issue_type FROM issues").fetchall()}
    assert len(kinds) == 20, kinds
