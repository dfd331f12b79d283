"""Every registered query beside its oracle on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from freshet.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(int(v)) if v == int(v) else repr(float(v))
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def same(spark, data, con, query, oracle):
    df = query(spark, data)
    got = df.collect()
    con.execute(oracle)
    names, want = [d[0] for d in con.description], con.fetchall()
    assert sorted(df.columns) == sorted(names)
    a = sorted([plain(r[c]) for c in sorted(df.columns)] for r in got)
    b = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in want)
    assert a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, tables, name):
    same(spark, data, tables, registry.QUERIES[name], registry.ORACLES[name])


def test_scaled_series_of_all_suppliers(spark, data):
    got = registry.QUERIES["t11_scale_series_all"](spark, data).select("node_id").distinct().count()
    assert got == spark.read.parquet(f"{data}/supplier.parquet").filter("s_suppkey IS NOT NULL").count()


def test_entry_points():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, data):
    assert registry.FLAGSHIP(spark, data).count() == 5
