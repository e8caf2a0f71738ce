from __future__ import annotations

from functools import lru_cache

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery import queries
from gleanery.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(ORACLES)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())


@pytest.fixture(scope="module", autouse=True)
def one_run():
    """Queries of one folder share a run here, so that what they have in common is computed once."""
    original = queries.RetrievalRun
    queries.RetrievalRun = lru_cache(None)(original)
    yield
    queries.RetrievalRun = original


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(x):
    return f"{x:.4f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", CORE)
def test_queries_equal_their_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    asked = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"select {asked} from ({ORACLES[name]})").fetchall()
    have = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted([plain(x) for x in r] for r in have) == sorted([plain(x) for x in r] for r in want)
