"""The correctness gate: every analytics query against its DuckDB oracle at sf0.01
(row count, column names and an order-insensitive value hash), plus the entry smoke check.
The optional subpackage's queries have their own gate beside its tests."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as ent
from riskbands.plans.catalog import QUERIES
from riskbands.plans.oracle import oracle_sql

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows))
                          .encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(ent.queries()) and set(oracle_sql()) <= set(ent.oracle_sql())


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert df.columns == ["risk_band", "total_transactions"] and len(rows) == 3
    assert {r.risk_band: r.total_transactions for r in rows} == {"low": 88, "mid": 748, "high": 164}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(oracle_sql()[name])
    orows = rel.fetchall()
    assert len(srows) == len(orows)
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, srows) == digest(rel.columns, orows)


def test_returned_numbers_are_not_cut():
    """Golden values of FIXTURES.md section 4; whole hours come back as whole hours."""
    from riskbands.session import build_session

    spark = build_session("local[*]", 8)
    got = QUERIES["revenue_new"](spark, "/root/testdata/sf0.01").first()
    assert got.total_approved == 1416099.16 and abs(got.total_revenue - 187744.39) < 1e-6
    rows = {r.column_name: r for r in QUERIES["describe_all"](spark, "/root/testdata/sf0.01").collect()}
    ts = rows["transaction_timestamp"]
    assert ts.min % 3_600_000 == 0 and ts.max % 3_600_000 == 0
