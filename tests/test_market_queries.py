"""Every market query with SQL is compared with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemill.plans import learning, market, more, patterns, rules, sampling, series, states, votes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else value


@pytest.mark.parametrize("name", sorted(market.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got = market.QUERIES[name](spark, SF)
    cur = db.execute(market.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(map(norm, r))) for r in cur.fetchall())
    assert sorted(repr(tuple(map(norm, r))) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(market.QUERIES) - set(market.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert market.QUERIES[name](spark, SF).count() > 0
