"""Every query that has SQL against DuckDB on the same tables; the others run."""

import math
import os

import duckdb
import pytest

import sievemark.plans.queries as plans
import sievemark.plans.reports as reports

QUERIES, ORACLES = plans.QUERIES | reports.QUERIES, plans.ORACLES | reports.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: f"{v:.4f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert tidy(got.columns, rows) == tidy(names, want.fetchall())
