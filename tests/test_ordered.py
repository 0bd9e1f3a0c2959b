"""Ordered scans and exact quantiles against plain windows and brute force."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.operators import ordered
from tablewash.operators.ordered import BUCKET, Running, fit_ranges, running
from tablewash.operators.quantiles import approx_quantiles, exact_quantiles

def outputs():
    return [
        Running("r", "rank"), Running("s", "sum", F.col("v")), Running("m", "max_before", F.col("v")),
        Running("l", "last", F.col("t")), Running("n", "next", F.col("t")), Running("f", "first", F.col("t")),
        Running("z", "final", F.col("t")), Running("p", "previous", F.col("t")), Running("w", "following", F.col("t")),
    ]


@pytest.fixture(scope="module")
def table(spark):
    # One group holds a third of the rows; the order key repeats apart from ``k``.
    rng = random.Random(1)
    rows = []
    for k in range(600):
        group = None if k % 50 == 0 else "hot" if k % 3 == 0 else f"g{rng.randrange(20)}"
        rows.append((k, group, rng.randrange(12), None if rng.random() < 0.1 else rng.randrange(100),
                     None if rng.random() < 0.5 else f"t{k}"))
    return spark.createDataFrame(rows, "k bigint, g string, d int, v int, t string").repartition(5)


def plain(df, group, order):
    w = Window.partitionBy(*group).orderBy(*order)
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("r"), F.sum("v").over(upto).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.last("t", True).over(upto).alias("l"),
        F.last("t", True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        F.first("t", True).over(whole).alias("f"), F.last("t", True).over(whole).alias("z"),
        F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("w"))


@pytest.mark.parametrize("buckets", [1, 13])
@pytest.mark.parametrize("group, order", [([], ["k"]), ([], ["d", "k"]), (["g"], ["k"]), (["g", "d"], ["k"])])
def test_running_equals_plain_window(table, group, order, buckets):
    got = running(table, order, outputs(), group, buckets).collect()
    want = plain(table, group, order).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_buckets_ascend_and_split_a_hot_group(table):
    rows = fit_ranges(table, ["g", "k"], 12).add(table).select("g", "k", F.col(BUCKET).alias("b")).collect()
    rows.sort(key=lambda r: (r["g"] is not None, r["g"] or "", r["k"]))
    found = [r["b"] for r in rows]
    assert found == sorted(found)
    assert len({r["b"] for r in rows if r["g"] == "hot"}) >= 3


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("group, order", [([], ["k"]), ([], ["d", "k"]), (["g"], ["k"]), (["g", "t"], ["k"])])
def test_written_boundaries_give_the_same_scan(spark, table, monkeypatch, group, order, broadcast):
    monkeypatch.setattr(ordered, "LITERAL_BUCKETS", 1)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        ranges = fit_ranges(table, group + order, 40)
        assert ranges.table is not None and (ranges.spread > 1) == (broadcast == "-1")
        rows = ranges.add(table).select(*group, *order, F.col(BUCKET).alias("b")).collect()
        got = running(table, order, outputs(), group, 40).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    rows.sort(key=lambda r: [(v is not None, v) for v in r[:-1]])
    found = [r["b"] for r in rows]
    assert found == sorted(found) and len(set(found)) >= 20
    assert max(found.count(b) for b in set(found)) <= 60
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain(table, group, order).collect()), key=repr)


def test_no_literal_above_its_bytes(spark, monkeypatch):
    # Neighbours differ only behind 3,000 equal characters, so no boundary can be short.
    rows = spark.range(300).select(F.concat(F.lit("y" * 3000), F.lpad("id", 4, "0")).alias("k"), F.col("id").alias("v"))
    assert fit_ranges(rows, ["k"], 20).table is None
    monkeypatch.setattr(ordered, "LITERAL_BYTES", 20_000)
    ranges = fit_ranges(rows, ["k"], 20)
    assert ranges.table is not None and len(ranges.literal) <= 20_000
    got = running(rows, ["k"], [Running("r", "rank")], buckets=20).where("r <> v").count()
    assert got == 0
    monkeypatch.setattr(ordered, "LITERAL_BYTES", 10)  # not even one boundary may stand in the plan
    ranges = fit_ranges(rows, ["k"], 20)
    assert ranges.literal == "[]"
    assert ranges.add(rows).select(BUCKET).distinct().count() >= 15


def test_all_null_and_single_keys_need_no_boundaries(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LITERAL_BUCKETS", 1)
    rows = spark.createDataFrame([(None,)], "k string")
    assert [r["r"] for r in running(rows, ["k"], [Running("r", "rank")], buckets=8).collect()] == [0]
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [r["r"] for r in running(rows, ["k"], [Running("r", "rank")], buckets=8).collect()] == [0]


def test_plan_never_gathers_rows_in_one_partition(table):
    scan = running(table, ["k"], [Running("r", "rank")], buckets=8)
    lines = scan._jdf.queryExecution().executedPlan().toString().splitlines()
    gathered = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    # Only the summary is gathered: one row per bucket, straight from its aggregate.
    assert len(gathered) == 1 and "Aggregate" in lines[gathered[0] + 1]
    assert sum("Exchange hashpartitioning(__bucket" in line for line in lines) >= 1


def test_grouped_scan_shuffles_the_rows_once(table):
    scan = running(table, ["k"], [Running("r", "rank"), Running("s", "sum", F.col("v"))], ["g"], buckets=8)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    above_join = plan[:plan.index("Join")]
    below_join = plan[plan.index("Join"):]
    assert above_join.count("Exchange hashpartitioning") + below_join.split("__group_c")[0].count("Exchange hashpartitioning") <= 1
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("small, fine", [(0, 10), (0, 1_000_000), (1_000_000, 1_000_000), (1_000_000, 5)])
def test_exact_quantiles(spark, small, fine):
    import numpy as np
    rng = np.random.default_rng(7)
    a = np.round(rng.normal(size=5_000), 2)
    b = np.where(rng.random(5_000) < 0.4, 5.0, rng.integers(0, 50, 5_000))  # one value holds 40%
    rows = [(float(x), None if i % 9 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, e double").repartition(6)
    probs = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = exact_quantiles(df, ["a", "b", "e"], probs, small=small, fine=fine)
    kept = np.array([y for i, y in enumerate(b) if i % 9])
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(kept, probs)))
    assert got["e"] == [None] * len(probs)


def test_quantiles_of_text_and_infinity(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",), ("inf",), ("-inf",)], "c string")
    assert exact_quantiles(df, ["c"], (0.5,)) == {"c": [2.0]}
    assert approx_quantiles(df, ["c"], (0.0,))["c"] == [float("-inf")]


def test_single_value(spark):
    assert exact_quantiles(spark.range(1), ["id"]) == {"id": [0.0, 0.0, 0.0]}
