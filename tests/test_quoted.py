"""CSV with line breaks in quotes, cut anywhere; differences of two tables."""

import random

import pytest
from pyspark.sql import functions as F

from tablewash.operators import diff
from tablewash.sources import quoted
from tablewash.sources.tables import read_table


@pytest.mark.parametrize("line, from_outside, from_inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, False), ('x"', False, False), ('x"y', False, False),
    ('"a ""q""', True, False), ('""', False, True), ('","', False, True), ('a"b,c', False, False), ('","x', False, True)])
def test_both_states_of_a_line(line, from_outside, from_inside):
    assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == (from_outside, from_inside)


def csv_of(seed):
    r = random.Random(seed)
    pieces = ["a", "b c", "\n", "\n\n", '""', ",", "é", "\t", "x" * 30, '"",""', "1"]
    cell = lambda: "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))
    lines = ["k,text,n"] + [f'{i},"{cell()}",{r.choice(("", "7", chr(34) * 2))}' for i in range(40)]
    return "\n".join(lines) + r.choice(("", "\n", "\n\n"))


@pytest.mark.parametrize("size", [7, 23, 64, 1000])
def test_equal_to_the_one_task_reader_cut_anywhere(spark, tmp_path, size):
    for seed in range(2):
        (tmp_path / f"part{seed}.csv").write_text(csv_of(10 * size + seed))
    one = {tuple(x) for x in read_table(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        many = read_table(spark, str(tmp_path), many_tasks=True)
        rows = [tuple(x) for x in many.collect()]
        tasks = quoted._lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 80 and set(rows) == one
    assert tasks > 1 or size == 1000


def test_windows_line_ends_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,t\r\n1,"x\ny"\r\n2,z\r\n')
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "a.csv"), many_tasks=True).collect())) == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "b.csv").write_text("k,t\n")
    assert read_table(spark, str(tmp_path / "b.csv"), many_tasks=True).collect() == []


def test_diff_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, a string, b double")
    before = make([(1, "x", 1.0), (2, "y", None), (None, "n", 2.0), (4, "d", 0.0), (4, "d", 0.0)])
    after = make([(1, "x", 5.0), (3, "z", 1.0), (None, "n", 3.0), (4, "d", 0.0), (4, "e", 0.0)])
    got = {tuple(x) for x in diff.diff_rows(before, after, ["k"]).collect()}
    assert got == {
        (1, "changed", "b", "1.0", "5.0"), (2, "removed", "a", "y", None), (2, "removed", "b", diff.MISSING_TEXT, None),
        (3, "added", "a", None, "z"), (3, "added", "b", None, "1.0"), (None, "changed", "b", "2.0", "3.0"), (4, "changed", "a", "d", "e")}
    assert diff.diff_rows(before, before, ["k"]).collect() == [] and diff.diff_rows(before.limit(0), before.limit(0), ["k"]).collect() == []
    assert diff.diff_rows(before, after.limit(0), ["k"]).where("change = 'removed'").count() == 10
