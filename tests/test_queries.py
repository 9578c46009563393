import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(df):
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        try:
            return f"{float(x):.4f}" if not isinstance(x, (bool, str)) else str(x)
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert plain(ours) == plain(duck.execute(sql).df())
    else:
        assert len(ours)


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "n"]


def test_streaming_reload(spark, tmp_path):
    from lanna.streaming.analysis import analyzed_stream, reloading, source
    from pyspark.sql import functions as F

    spark.createDataFrame([("a b",), ("c",)], "t string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = analyzed_stream(source(spark, str(tmp_path / "in")), "t", lambda c: F.split(c, " "))
    run = reloading(stream, lambda: "x", lambda df, word: df.withColumn("w", F.lit(word)), lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(len(r["tokens"]) for r in seen) == [1, 2] and {r["w"] for r in seen} == {"x"}
