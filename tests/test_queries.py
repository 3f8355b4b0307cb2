"""Every query of the library beside its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    out = duck.sql(catalog.ORACLE_SQL[name])
    at = [out.columns.index(c) for c in columns]
    assert sorted(out.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_record_is_looked_up(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for name, column in (("keyed_asof", "at"), ("retire_cas", "offset"), ("record_age", "offset")):
        assert catalog.QUERIES[name](spark, SF).select(column).distinct().count() == n
    assert catalog.QUERIES["record_age"](spark, SF).select("ms").distinct().count() > n // 100 - 1
