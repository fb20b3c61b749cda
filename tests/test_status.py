"""Status payloads against their SQL where a percentage is half-way between two tenths."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.functions import segments


def test_half_tenths(spark, tmp_path):
    # Conversations of 2000, 4000 and 1600 characters, cut at odd places.
    cuts = [(2000, [9, 37, 67, 69, 143, 1001]), (4000, [18, 74, 286, 2002]), (1600, [100, 300, 1500])]
    rows = []
    for total, ends in cuts:
        for turn, (low, high) in enumerate(zip([0, *ends], [*ends, total], strict=True)):
            rows.append((total, turn, ("user", "assistant")[turn % 2], "x" * (high - low)))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = entry.queries()["status_payloads"](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {names} FROM ({entry.oracle_sql()['status_payloads']})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_all_ties(spark):
    """Every such share of up to 4,000 characters."""
    shares = [(k / 15.0, n / 15.0) for n in range(16, 4001, 16) for k in range(1, n) if 2000 * k % (2 * n) == n]
    df = spark.createDataFrame(shares, "a double, b double")
    found = df.select("a", "b", segments.percent(F.col("a"), F.col("b")).alias("p")).toArrow()
    con = duckdb.connect()
    con.register("found", found)
    assert con.execute("SELECT count(*) FROM found WHERE p IS DISTINCT FROM round(a / b * 100, 1)").fetchone() == (0,)
