"""The driver's queries against their SQL, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return value.isoformat() if isinstance(value, datetime.datetime) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert rows
    if name in entry.oracle_sql():
        names = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(tuple(map(plain, r)) for r in duck.execute(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
