"""How often work is done that grows with the table, read off the plans."""

import re

from pyspark.sql import functions as F

from tablewash.functions.parse import to_timestamp_mixed
from tablewash.operators import detect, quality


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_is_stripped_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(0, " 2020-01-31 "), (1, "31/12/2020 1:05 pm"), (2, "$12:30"), (3, None)], "k int, c string").write.parquet(path)
    df = spark.read.parquet(path)
    read = df.select("k", to_timestamp_mixed(F.col("c"), df.schema["c"].dataType).alias("t"))
    assert [str(r["t"]) for r in read.orderBy("k").collect()] == ["2020-01-31 00:00:00", "2020-12-31 13:05:00", "None", "None"]
    assert plan(read).count("trim(") == 1


def test_equal_cells_are_read_once(spark):
    cells = ["2020-01-01"] * 3 + [" Yes", "yes", "Yes", "7", "7", None]
    signs = detect.cell_signs(spark.createDataFrame([*enumerate(cells)], "k int, c string"), ["k"])
    assert [tuple(r) for r in signs.collect()] == [("c", 8, 3, 2, 1, 2, 4)]
    assert re.search(r"Aggregate \[column#\d+, cell#\d+\]", plan(signs))


def test_a_scored_value_is_counted_and_placed_once(spark, monkeypatch):
    written, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df: (written.append(plan(df)), write(df))[1])
    rows = [(i, float(i % 7), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, x double, s string")
    matches = quality.column_matches(df, df.where("k < 30"), buckets=3)
    assert sorted(tuple(r) for r in matches.collect()) == [("k", "number", 30), ("s", "text", 25), ("x", "number", 11)]
    assert [p.count("inline(") for p in written] == [2, 0]
