"""Profiles, detection, differences."""

import pandas as pd
import pytest

from tablewash.operators import detect, diff, profile, rows
from tablewash.sources.tables import TableSet

ROWS = [
    (0, "Emp_001", 30.0, " yes", "2023-01-01", "1.5", True), (1, "Emp_002", None, "no", "01-Feb-2023", "2", False),
    (2, None, 50.0, "YES", "Mar 1 2023", "x", None), (3, "Emp_004", 30.0, "no", None, "4", True),
    (3, "Emp_004", 30.0, "no", None, "4", True),
]
SCHEMA = "k int, emp_name string, age double, active string, day string, amount string, ok boolean"


@pytest.fixture
def staff(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def facts(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_profile(staff):
    table = facts(profile.profile_table(staff))
    assert table["age"]["nulls"] == 1 and table["age"]["median"] == 30.0 and table["age"]["rows"] == 5
    assert table["age"]["duplicates"] == 1 and table["ok"]["type"] == "bool" and table["ok"]["mean"] is None
    assert table["emp_name"]["distinct"] == 3 and table["day"]["type"] == "string"


def test_distribution_equals_pandas(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    s = pd.Series(values)
    got = profile.distribution(spark.createDataFrame([(v,) for v in values], "x double")).first()
    assert got["skew"] == pytest.approx(s.skew()) and got["std"] == pytest.approx(s.std())
    assert [got["q1"], got["median"], got["q3"]] == pytest.approx([s.quantile(q) for q in (0.25, 0.5, 0.75)])


@pytest.mark.parametrize("values, skew", [([1.0, 2.0], None), ([5.0, 5.0, 5.0], 0.0)])
def test_skew_corner_cases(spark, values, skew):
    assert profile.distribution(spark.createDataFrame([(v,) for v in values], "x double")).first()["skew"] == skew


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert profile.null_counts(df).first()["nulls"] == 2
    assert profile.distribution(df).first()["mean"] == 1.0


def test_profile_of_a_set_and_comparison(staff):
    tables = TableSet({"a": staff, "b": staff.select("k", "age")})
    assert profile.profile_tables(tables).count() == 9
    assert {(r["table"], r["rows"], r["columns"]) for r in profile.table_shapes(tables).collect()} == {("a", 5, 7), ("b", 5, 2)}
    same = profile.compare_distributions(staff, staff).collect()
    assert len(same) == 8 and all(r["delta"] in (0.0, None) for r in same)


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert profile.distribution(df).count() == 0 and detect.outlier_counts(df).count() == 0


def test_detection(staff):
    dates = facts(detect.detect_dates(staff, ["k"]))
    assert dates["day"]["is_date"] and not dates["amount"]["is_date"]
    names = facts(detect.detect_identifiers(staff))
    assert names["emp_name"]["is_identifier"] and not names["active"]["is_identifier"]
    assert facts(detect.detect_sequential(staff, ["k"]))["emp_name"]["is_sequential"]
    found = {(r["column"], r["issue"]) for r in detect.analyze_table(staff, ["k"]).collect()}
    assert {("age", "missing"), (None, "duplicates"), ("active", "whitespace"), ("active", "boolean_like"),
            ("amount", "number_as_text"), ("day", "date_as_text")} <= found
    assert ("age", "outliers") not in found
    assert detect.analyze_table(staff, ["k"], sample=None).count() == len(found)


def test_outlier_rules(spark):
    df = spark.createDataFrame([(float(i % 10), 1.0) for i in range(40)] + [(500.0, 1.0)], "a double, same double")
    assert {(r[0], r[1]) for r in detect.outlier_counts(df).collect()} == {("a", 1)}
    assert detect.outlier_counts(df.limit(5)).count() == 0


def test_hints(staff):
    hints = detect.describe_columns(staff, ["k"])
    assert "fill with median" in hints["age"] and "sequential" in hints["emp_name"]
    assert "forward fill" in hints["day"] and "datetime" in hints["day"]
    assert "boolean" in hints["active"] and "whitespace" in hints["active"].lower() and hints["ok"] == "Boolean column."


def test_differences(staff):
    after = rows.drop_duplicates(staff).na.fill({"age": 1.0})
    shape = diff.impact(staff, after).first()
    assert (shape["rows_removed"], shape["nulls_fixed"], shape["duplicates_before"], shape["duplicates_after"]) == (1, 2, 1, 0)
    assert {r["column"] for r in diff.null_changes(staff, after).collect()} == {"age", "day"}
    bad = diff.dry_run(staff, lambda df: rows.remove_outliers(df, "nothing")).first()
    assert not bad["valid"] and "nothing" in bad["error"] and bad["rows_before"] is None
    assert diff.dry_run(staff, rows.drop_duplicates).first()["valid"]


def test_changed_cells(spark):
    before = spark.createDataFrame([(i, "a", None) for i in range(10)], "k int, x string, y string")
    after = before.selectExpr("k", "'b' AS x", "CASE WHEN k < 2 THEN 'n' END AS y")
    assert diff.changed_cells(before, after, ["k"]).count() == 12
    report = [(r["k"], r["column"], r["old_value"], r["new_value"]) for r in diff.sample_changes(before, after, ["k"]).collect()]
    assert report == [(0, "x", "a", "b"), (1, "x", "a", "b"), (2, "x", "a", "b"), (0, "y", "__NA__", "n"), (1, "y", "__NA__", "n")]
    assert diff.sample_changes(before, after.limit(3), ["k"]).count() == 0


def test_empty_table(staff):
    empty = staff.limit(0)
    assert facts(profile.profile_table(empty))["age"]["rows"] == 0
    assert detect.describe_columns(empty, ["k"])["age"] == "Numeric column (all values missing)."
    assert detect.analyze_table(empty, ["k"]).count() == 0
