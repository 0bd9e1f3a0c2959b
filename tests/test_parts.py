"""Profiles that merge against the profile of the whole table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablewash.errors import CleaningError
from tablewash.operators.parts import merge_parts, parts_profile, profile_folder, profile_parts
from tablewash.operators.profile import cardinality, distribution, null_counts


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(5), []
    for i in range(6_000):
        day = None if i % 40 == 0 else "hot" if i % 3 == 0 else f"d{i % 7}"
        x = None if i % 11 == 0 else float("nan") if i % 13 == 0 else 1e6 + rng.gauss(0, 1) ** 3
        rows.append((day, i % 900, x, None if i % 5 == 0 else f"t{rng.randrange(400)}", 7 if i % 2 else None, None))
    return spark.createDataFrame(rows, "day string, n bigint, x double, t string, same int, none double").repartition(6)


EXACT = ("mean", "std", "min", "max", "skew")


def check(table, got):
    columns = [c for c in table.columns if c != "day"]
    assert set(got) == set(columns)
    rows = table.count()
    nulls = {r["column"]: r["nulls"] for r in null_counts(table).collect()}
    distinct = {r["column"]: r["distinct"] for r in cardinality(table).collect()}
    for c in columns:
        assert (got[c]["rows"], got[c]["nulls"], got[c]["cells"]) == (rows, nulls[c], rows - nulls[c])
        assert abs(got[c]["distinct"] - distinct.get(c, 0)) <= 0.05 * distinct.get(c, 0)
    for want in distribution(table.drop("day")).collect():
        mine = got[want["column"]]
        for s in EXACT:
            assert mine[s] == want[s] if want[s] is None else math.isclose(mine[s], want[s], rel_tol=1e-6, abs_tol=1e-9), (want["column"], s)
        if want["cells"]:
            numbers = [r[0] for r in table.select(F.col(want["column"]).cast("double")).where(
                F.col(want["column"]).isNotNull() & ~F.isnan(F.col(want["column"]).cast("double"))).collect()]
            for s, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                below = sum(v < mine[s] for v in numbers) / len(numbers)
                upto = sum(v <= mine[s] for v in numbers) / len(numbers)
                assert below - 0.01 <= p <= upto + 0.01, (want["column"], s)
        else:
            assert mine["median"] is None


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile_of_the_union_equals_the_merge(table):
    parts = profile_parts(table, ["day"])
    check(table, by_column(parts_profile(parts)))
    check(table, by_column(parts_profile(profile_parts(table.drop("day")))))


def test_merging_in_steps_and_by_part(table):
    parts = profile_parts(table, ["day"]).withColumn("kind", F.when(F.col("day") == "hot", "hot"))
    coarse = merge_parts(parts, ["kind"])
    assert coarse.select("kind").distinct().count() == 2  # NULL is a part like any other
    check(table, by_column(parts_profile(coarse)))
    hot = table.where("day = 'hot'")
    check(hot, by_column(parts_profile(coarse, ["kind"]).where("kind = 'hot'")))


def test_a_grown_folder_reads_its_new_files_only(spark, table, tmp_path):
    folder, state = str(tmp_path / "t"), str(tmp_path / "state")
    rows = table.drop("day")
    rows.where("n < 300").write.parquet(folder)
    check(rows.where("n < 300"), by_column(profile_folder(spark, folder, state)))
    before = {tuple(r) for r in spark.read.parquet(state).select("part", "column").collect()}
    rows.where("n >= 300").write.mode("append").parquet(folder)
    check(rows, by_column(profile_folder(spark, folder, state)))
    after = [tuple(r) for r in spark.read.parquet(state).select("part", "column").collect()]
    assert before < set(after) and len(after) == len(set(after))
    check(rows, by_column(profile_folder(spark, folder, state)))
    assert spark.read.parquet(state).count() == len(after)
    rows.where("n < 10").coalesce(1).write.mode("overwrite").parquet(folder)  # all earlier files go
    check(rows.where("n < 10"), by_column(profile_folder(spark, folder, state)))


def test_empty_table_and_clashing_names(spark, table):
    assert parts_profile(profile_parts(table.where("false"), ["day"])).count() == 0
    with pytest.raises(CleaningError):
        profile_parts(table.withColumnRenamed("day", "column"), ["column"])
