"""Every query against its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

import datetime
import math

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v.replace(tzinfo=None))
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    answer = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r)) for r in answer.fetchall()]
    assert got == sorted([plain(r[c]) for c in columns] for r in rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
