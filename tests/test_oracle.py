"""Every registered query against its SQL over the same parquet tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from keeprank import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    order = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=str)
    if key not in ORACLES:
        assert got, "a rows-only query must return rows"
        return
    cur = duck.execute(ORACLES[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    want = sorted((tuple(clean(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert {"user_id", "rank", "item_id", "score"} <= set(entry.entry(spark).columns)
