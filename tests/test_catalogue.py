"""Every registered query of the relational engine against its SQL twin in DuckDB."""

import decimal
import math

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v.normalize()) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    out.execute("SET TimeZone='UTC'")
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, sf, db, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    cursor = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == want


#: No row is right: a NULL among the values leaves nothing that is not in them, and at this scale every customer has orders.
EMPTY_BY_MEANING = {"not_in_sub_null", "where_doesnt_have"}


def test_no_query_stands_on_nothing(spark):
    """Results that are empty prove nothing."""
    empty = {n for n in catalogue.oracle_sql() if catalogue.queries()[n](spark, "/root/testdata/sf0.01").limit(1).count() == 0}
    assert empty == EMPTY_BY_MEANING


@pytest.fixture(scope="module")
def nothing(spark, sf, tmp_path_factory):
    """The tables without rows."""
    folder = tmp_path_factory.mktemp("nothing")
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_empty_tables(spark, nothing, name):
    """Every query runs on empty tables; what groups nothing gives no row, what aggregates without groups one."""
    assert len(catalogue.queries()[name](spark, nothing).collect()) <= 1
