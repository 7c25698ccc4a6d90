"""Every registered log query against its SQL over the smallest sample tables, and the contract's shape."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from lorekeep import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(DIR):
        pytest.skip("no sample tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, DIR)
    theirs = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in mine.collect())
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in theirs.fetchall())
    assert got == want


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).columns == ["stream_id", "balance", "version"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
