import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op")]


def text(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(tuple(text(r[c]) for c in order) for r in df.collect()) == sorted(tuple(text(r[columns.index(c)]) for c in order) for r in want.fetchall())


def test_entry_and_import_without_text_operators(spark):
    assert entry.entry(spark).count() == 1
    assert all(k.split("_")[0][0] in "scxpkgfahijto" for k in entry.queries())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
