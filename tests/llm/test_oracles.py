"""The queries of this subpackage against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strandline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, DATA)
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(f"SELECT {names} FROM ({queries.oracle_sql()[name]})").fetchall()))
