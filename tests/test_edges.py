"""Inputs that friendly tables do not have."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.errors import CleaningError
from tablewash.operators import detect, fills, profile, rows
from tablewash.operators.ordered import Running, range_bucket, running
from tablewash.plans.auto import auto_clean, retype_losses
from tablewash.sources.tables import preview, read_table
from tablewash.streaming.stream import apply_cell_steps, keep_known


def shared_prefix(spark, n=400):
    return spark.range(n).selectExpr("id", "repeat('x', 300) || lpad(cast(id * 7919 % 1000 as string), 4, '0') AS t",
                                     "CASE WHEN id % 5 = 0 THEN id END AS v")


def test_scans_over_long_shared_texts(spark):
    df = shared_prefix(spark)
    ranked = running(df, ["t", "id"], [Running("r", "rank")], buckets=8)
    wanted = df.withColumn("w", F.row_number().over(Window.orderBy("t", "id")) - 1)
    assert ranked.join(wanted, "id").where("r <> w").count() == 0
    sizes = [r["count"] for r in df.groupBy(range_bucket(df, ["t"], 8).alias("b")).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 3 * 400 / 8


def test_null_keys_carry_their_value(spark):
    df = spark.createDataFrame([(None, "a")] + [(i, None) for i in range(40)], "k int, v string")
    assert {r.v for r in fills.fill_forward(df, "v", ["k"]).collect()} == {"a"}


def test_ties_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, v string")
    with pytest.raises(PySparkException, match="share the order key"):
        fills.fill_forward(df, "v", ["k"]).collect()


def test_first_cells_do_not_decide(spark):
    df = spark.createDataFrame([(i, str(i) if i < 20 else f"word{i}") for i in range(500)], "k int, c string")
    assert detect.text_issues(df, ["k"]).count() == 0
    done = auto_clean(df, ["k"], level="medium")
    assert dict(done.dtypes)["c"] == "string" and done.where("c IS NULL").count() == 0
    mostly = spark.createDataFrame([(i, str(i) if i < 90 else "n/k") for i in range(100)], "k int, c string")
    assert [tuple(r) for r in retype_losses(mostly, ["k"]).collect()] == [("c", "float", 10)]


def test_one_scan_for_all_columns(spark, tmp_path):
    spark.createDataFrame([("a", "b", "1")], "x string, y string, k string").write.parquet(str(tmp_path / "t"))
    plan = detect.cell_signs(spark.read.parquet(str(tmp_path / "t")), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_quoted_lines_and_long_integers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,t,n,w\n1,"a\nb",1234567890123456789,12345678901234567890123\n2,c,1234567890123456788,1\n')
    df = read_table(spark, str(path), infer=True)
    assert [tuple(r) for r in df.select("k", "t", "n").orderBy("k").collect()] == [(1, "a\nb", 1234567890123456789), (2, "c", 1234567890123456788)]
    assert dict(df.dtypes)["w"] == "decimal(38,0)"
    assert preview(spark.range(100), ["id"], 50).count() == 50


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 1)], "x double, k int")
    assert rows.drop_duplicates(df).count() == 1
    assert profile.duplicate_count(df).first()[0] == 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (None, "b"), (9, "c")], "f int, v string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("f int, v string").parquet(str(tmp_path / "s"))
    with pytest.raises(CleaningError):
        apply_cell_steps(stream, [{"action_type": "remove_outliers", "column": "f", "method": "constant"}])
    keys = spark.createDataFrame([(1,)], "k int")
    query = keep_known(stream, "f", keys, "k").writeStream.trigger(availableNow=True).format("memory").queryName("known").start()
    query.awaitTermination()
    assert {r.v for r in spark.table("known").collect()} == {"a", "b"}


def test_long_identifier_numbers_go_on(spark):
    cells = ["A12345678901234567890", None, "A12345678901234567892", None]
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    out = [r.c for r in fills.fill_sequential(df, "c", ["k"]).orderBy("k").collect()]
    assert out == ["A12345678901234567890", "A12345678901234567891", "A12345678901234567892", "A12345678901234567893"]
    longer = df.withColumn("c", F.concat("c", F.lit("0" * 30)))
    with pytest.raises(CleaningError):
        fills.fill_sequential(longer, "c", ["k"])
