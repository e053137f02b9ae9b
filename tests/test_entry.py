"""The driver's contract: names, schemas, and every SQL against its query on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stemma.plans import registry
from stemma.session import TABLES

ROOT = "/root/testdata/sf0.001"
HAVE = os.path.isdir(ROOT)


def test_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.skipif(not HAVE, reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "paper_key", "decompose_query", "mine_words", "merge_tasks", "task_upsert", "year_windows", "partition_invariants"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    df = registry.QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(repr(tuple(r)) for r in rel.select(", ".join(cols)).fetchall())
