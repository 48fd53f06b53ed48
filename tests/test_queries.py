"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from sunlattice.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v + 0.0, 3) if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    want = plain(found)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 1e-3 * max(1, abs(b)) * 0.01 + 1e-3 * (a != b) for a, b in zip(g, w)), (g, w)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
