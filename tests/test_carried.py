"""Forward fill along a stream against the same fill of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tablewash.errors import CleaningError
from tablewash.operators.fills import fill_forward
from tablewash.streaming.carried import ForwardFill
from tablewash.streaming.stream import run_available

SCHEMA = "k bigint, g string, v double, note string"


@pytest.fixture(scope="module")
def rows():
    # One group holds a third of the rows, one is NULL, one never has a value, some get theirs late.
    rng, out = random.Random(3), []
    for k in range(240):
        g = "hot" if k % 3 == 0 else rng.choice([None, "a", "b", "late", "never"])
        empty = g == "never" or (g == "late" and k < 150) or rng.random() < 0.6
        out.append((k, g, float("nan") if empty and k % 2 else None if empty else float(k), f"n{k}"))
    return out


def slices(rows, n):
    step = -(-len(rows) // n)
    return [rows[i:i + step] for i in range(0, len(rows), step)]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [["g"], []])
def test_stream_equals_batch_also_after_crashes(spark, rows, tmp_path, group):
    whole = spark.createDataFrame(rows, SCHEMA)
    (tmp_path / "in").mkdir()
    fill = ForwardFill(whole.schema, "v", ["k"], group, str(tmp_path / "fill"), compact_every=2)
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    crashed = []

    def stops_once(batch, number):
        # Batch 2 dies with its state unwritten, batch 3 with everything written but not committed.
        if number in (2, 3) and number not in crashed:
            crashed.append(number)
            if number == 2:
                whole.limit(3).write.mode("overwrite").parquet(fill._path("out", 2))
            else:
                fill(batch, number)
            raise RuntimeError("lost")
        fill(batch, number)

    for part in slices(rows, 5):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            try:
                run_available(stream, "", str(tmp_path / "checkpoint"), stops_once)
                break
            except Exception as e:
                assert "lost" in str(e)
    assert crashed == [2, 3]
    want = fill_forward(whole, "v", ["k"], partition_by=group)
    assert sorted_rows(fill.filled(spark, rest=True)) == sorted_rows(want)
    assert sorted_rows(fill.filled(spark)) == sorted_rows(want.where("v is not null"))


def test_empty_batches_and_a_state_of_touched_groups(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    fill = ForwardFill(empty.schema, "v", ["k"], ["g"], str(tmp_path), compact_every=3)
    assert fill.filled(spark, rest=True).count() == 0
    parts = [[], [(1, "a", None, "x"), (2, "b", 2.0, "y")], [], [(3, "b", None, "z")], [(4, "a", 4.0, "w")]]
    for n, part in enumerate(parts):
        fill(spark.createDataFrame(part, SCHEMA), n)
    got = {r["k"]: r["v"] for r in fill.filled(spark, rest=True).collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 2.0, 4: 4.0}
    sizes = [spark.read.parquet(fill._path("state", n)).count() for n in range(5)]
    assert sizes == [0, 2, 0, 2, 1]  # batch 3 holds every group, the others those they touched


def test_late_rows_and_ties_fail(spark, tmp_path):
    df = spark.createDataFrame([(5, "a", 1.0, "x")], SCHEMA)
    fill = ForwardFill(df.schema, "v", ["k"], ["g"], str(tmp_path))
    fill(df, 0)
    with pytest.raises(Exception, match="behind a later one"):
        fill(spark.createDataFrame([(4, "a", None, "late")], SCHEMA), 1)
    with pytest.raises(Exception, match="share the order key"):
        fill(spark.createDataFrame([(6, "a", None, "p"), (6, "a", None, "q")], SCHEMA), 1)
    fill(spark.createDataFrame([(4, "b", None, "own group"), (6, "a", None, "next")], SCHEMA), 1)
    assert fill.filled(spark).where(F.col("k") == 6).first()["v"] == 1.0


def test_needs_its_columns(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    for bad in (dict(column="x", order_by=["k"]), dict(column="v", order_by=[]), dict(column="v", order_by=["v"])):
        with pytest.raises(CleaningError):
            ForwardFill(schema, partition_by=["g"], folder=str(tmp_path), **bad)
