"""Every registered query against its SQL form in DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(x):
    """Numbers by value, floats to nine digits; timestamps without their zone, which is UTC on both sides."""
    if isinstance(x, float):
        return None if math.isnan(x) else str(float(f"{x:.9g}")).removesuffix(".0")
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return x if x is None else str(x).removesuffix(".0")


def rows(found):
    """Rows of an Arrow table in an order of their own, columns by name. Arrow keeps whole numbers whole beside nulls."""
    names = sorted(found.column_names)
    return sorted((tuple(plain(r[n]) for n in names) for r in found.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toArrow()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = duck.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_names_are_unique_and_documented():
    assert all(q.__doc__ for q in catalogue.queries().values())
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
