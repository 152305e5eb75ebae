"""The optional queries: registered with the others, and equal to their DuckDB SQL where they have one."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as ent
from riskbands.llm.oracle import ORACLE_SQL
from riskbands.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.abspath(ent.__file__))


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(ent.queries()) and set(ORACLE_SQL) <= set(ent.oracle_sql())
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    order = [df.columns.index(c) for c in rel.columns]
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r[k] for k in order) for r in df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_entry_stays_without_a_library():
    """A library that only the training-data operators need may be missing; the other queries stay."""
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), 'risk_bands' in e.queries(), 'pipeline' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, bands, pipeline = out.stdout.split()
    assert int(n) >= 52 and bands == "True" and pipeline == "False" and "xxhash" in out.stderr
