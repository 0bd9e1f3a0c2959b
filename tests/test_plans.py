"""Steps as data, automatic cleaning, suggested steps, streams."""

import uuid

import pytest

from tablewash.errors import CleaningError
from tablewash.operators import quality
from tablewash.operators.fits import Bounds
from tablewash.plans.auto import auto_clean
from tablewash.plans.steps import Step, apply_step, run_steps
from tablewash.plans.suggest import clean_by_hints, fill_choice
from tablewash.sources.tables import Relationship, TableSet
from tablewash.streaming import stream as st


@pytest.mark.parametrize("fields", [
    {"action_type": "fill_null", "column": "a"}, {"action_type": "fill_null", "method": "mean"},
    {"action_type": "fill_null", "column": "a", "method": "constant"}, {"action_type": "convert_type", "column": "a"},
    {"action_type": "normalize"}, {"action_type": "map_values", "column": "a", "mapping": {}},
    {"action_type": "replace_substring", "column": "a", "old_value": "x"}, {"action_type": "dance"},
    {"action_type": "lookup_fill", "column": "a"}, {"action_type": "validate_foreign_key", "table": "t"},
    {"action_type": "fill_null", "column": "a", "method": "magic"}, {"column": "a"},
    {"action_type": "strip_whitespace", "column": "a", "color": "red"},
    {"action_type": "convert_type", "column": "a", "target_type": "money"},
])
def test_bad_steps(fields):
    with pytest.raises(CleaningError):
        Step.from_dict(fields)


def test_good_steps_have_a_sentence():
    assert Step("drop_duplicates").sentence(10, 8) == "Removed 2 of 10 rows as duplicates"
    assert "median" in Step("fill_null", "a", method="median").sentence()
    assert Step("replace_substring", "a", old_value="$", new_value="").sentence() == "Removed '$' from a"


STAFF = [
    (0, "Emp_000", 30.0, "A", "2023-01-01", "$1,000.00"), (1, None, None, None, None, None),
    (2, "Emp_002", 50.0, "A", "2023-01-03", "$3,000.00"), (3, "Emp_003", 40.0, "B", None, "$2,000.00"),
    (3, "Emp_003", 40.0, "B", None, "$2,000.00"),
]
SCHEMA = "k int, emp_name string, age double, dept string, day string, pay string"
RECIPE = [
    {"action_type": "drop_duplicates"}, {"action_type": "replace_substring", "column": "pay", "old_value": "$", "new_value": ""},
    {"action_type": "replace_substring", "column": "pay", "old_value": ",", "new_value": ""},
    {"action_type": "convert_type", "column": "pay", "target_type": "float"},
    {"action_type": "fill_null", "column": "pay", "method": "median"}, {"action_type": "fill_null", "column": "age", "method": "mean"},
    {"action_type": "fill_null", "column": "emp_name", "method": "sequential"},
    {"action_type": "fill_null", "column": "dept", "method": "mode"}, {"action_type": "fill_null", "column": "day", "method": "forward_fill"},
    {"action_type": "convert_type", "column": "day", "target_type": "datetime"},
]


def test_run_steps(spark):
    done = run_steps(spark.createDataFrame(STAFF, SCHEMA), RECIPE, ["k"]).orderBy("k").collect()
    assert [(r["k"], r["emp_name"], r["age"], r["dept"], r["day"].day, r["pay"]) for r in done] == [
        (0, "Emp_000", 30.0, "A", 1, 1000.0), (1, "Emp_001", 40.0, "A", 1, 2000.0),
        (2, "Emp_002", 50.0, "A", 3, 3000.0), (3, "Emp_003", 40.0, "B", 3, 2000.0)]


def test_fused_fills_equal_single_steps(spark):
    df = spark.createDataFrame(STAFF[:4], SCHEMA)
    alone = df
    for s in RECIPE[1:]:
        alone = apply_step(alone, Step.from_dict(s), ["k"])
    assert sorted(run_steps(df, RECIPE[1:], ["k"]).collect()) == sorted(alone.collect())


def test_steps_on_a_set(spark):
    tables = TableSet(
        {"orders": spark.createDataFrame([(1, "c1", None), (2, "c9", "x"), (3, None, "y")], "k int, cust string, city string"),
         "customers": spark.createDataFrame([("c1", " Rome ")], "id string, city string")},
        (Relationship("orders", "cust", "customers", "id"),), primary="orders", order_by={"orders": ["k"], "customers": ["id"]})
    done = run_steps(tables, [
        {"action_type": "strip_whitespace", "column": "city", "table": "customers"},
        {"action_type": "validate_foreign_key", "table": "orders", "foreign_key_column": "cust", "lookup_table": "customers", "lookup_key_column": "id"},
        {"action_type": "lookup_fill", "table": "orders", "column": "city", "foreign_key_column": "cust",
         "lookup_table": "customers", "lookup_key_column": "id", "lookup_value_column": "city"},
        {"action_type": "fill_null", "column": "cust", "method": "constant", "constant_value": "?"},
    ])
    assert sorted(map(tuple, done["orders"].collect())) == [(1, "c1", "Rome"), (3, "?", "y")]
    with pytest.raises(CleaningError):
        run_steps(tables, [{"action_type": "drop_duplicates", "table": "nothing"}])
    with pytest.raises(CleaningError):
        run_steps(tables["orders"], [{"action_type": "validate_foreign_key", "table": "orders", "foreign_key_column": "cust",
                                      "lookup_table": "customers", "lookup_key_column": "id"}])


def test_auto_clean(spark):
    df = spark.createDataFrame(
        [(i, None if i == 4 else f"Emp_{i:03d}", None if i % 7 == 3 else float(i % 10), " yes " if i % 2 else "no",
          None if i == 6 else f"2023-01-{i % 28 + 1:02d}", f"{i}.5", 900.0 if i == 20 else float(i % 5)) for i in range(40)] * 2,
        "k int, emp_name string, age double, active string, day string, amount string, x double")
    easy = auto_clean(df, ["k"], "easy")
    assert easy.count() == 40 and easy.where("emp_name = 'Emp_004' and k = 4").count() == 1
    assert dict(easy.dtypes)["day"] == "timestamp" and dict(easy.dtypes)["active"] == "string"
    medium = auto_clean(df, ["k"], "medium")
    assert dict(medium.dtypes)["active"] == "boolean" and dict(medium.dtypes)["amount"] == "double"
    hard = auto_clean(df, ["k"], "hard")
    assert hard.count() == 39 and hard.where("x > 100").count() == 0
    assert all(hard.where(f"{c} is null").count() == 0 for c in hard.columns)
    assert auto_clean(df, ["k"], truth=easy) is easy
    with pytest.raises(CleaningError):
        auto_clean(df, ["k"], "brutal")


@pytest.mark.parametrize("hint, kind, sequential, choice", [
    ("fill with sequential method", "string", False, ("sequential", None)),
    ("Customer name", "string", True, ("sequential", None)), ("Customer name", "string", False, ("constant", "Unknown")),
    ("fill with constant 'pending'", "string", False, ("constant", "pending")),
    ("use forward fill", "string", False, ("forward_fill", None)), ("Start date, 5 missing", "string", False, ("forward_fill", None)),
    ("use the mean", "float", False, ("mean", None)), ("Categorical", "string", False, ("mode", None)),
    ("", "float", False, ("median", None)),
])
def test_fill_choice(hint, kind, sequential, choice):
    assert fill_choice(hint, kind, sequential) == choice


def test_hints_lead_to_a_clean_table(spark):
    hints = {
        "emp_name": "Employee identifier, sequential pattern. Missing: fill with the sequential method.",
        "age": "Age. Numeric. Missing values should use median.", "dept": "Missing: fill with constant 'Unknown'.",
        "day": "Should be datetime. Missing values: use forward fill.", "pay": "Salary in USD stored as string with '$' and ','. Convert to float."}
    rows = [(i, None if i % 9 == 4 else f"Emp_{i:03d}", None if i % 8 == 3 else float(20 + i % 30), "A" if i % 3 else None,
             None if i % 10 == 7 else f"2023-02-{i % 28 + 1:02d}", f"${i},000.50") for i in range(60)]
    raw = spark.createDataFrame(rows + rows[:5], SCHEMA)
    done, steps = clean_by_hints(raw, hints, ["k"])
    truth = run_steps(raw, [
        {"action_type": "drop_duplicates"}, *RECIPE[1:4], {"action_type": "fill_null", "column": "age", "method": "median"},
        RECIPE[6], {"action_type": "fill_null", "column": "dept", "method": "constant", "constant_value": "Unknown"}, RECIPE[8], RECIPE[9]], ["k"])
    assert quality.score_quality(done, truth).first()["overall"] >= 0.94
    assert sorted(done.collect()) == sorted(truth.collect())
    assert [s.action_type for s in steps][0] == "drop_duplicates"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = spark.createDataFrame([(i, f" n{i} ", float(i), i % 4) for i in range(20)], "k int, s string, x double, fk int")
    batch.write.parquet(source)
    def finish(stream):
        out, mark = str(tmp_path / uuid.uuid4().hex), str(tmp_path / uuid.uuid4().hex)
        st.run_available(stream, out, mark)
        return spark.read.parquet(out)
    def stream():
        return spark.readStream.schema(batch.schema).parquet(source)
    steps = [{"action_type": "strip_whitespace", "column": "s"}]
    assert sorted(finish(st.apply_cell_steps(stream(), steps)).collect()) == sorted(run_steps(batch, steps).collect())
    kept = finish(st.apply_fitted(stream(), bounds={"x": Bounds(2.0, 9.0)}))
    assert sorted(r["x"] for r in kept.collect()) == [float(i) for i in range(2, 10)]
    assert finish(st.keep_known(stream(), "fk", spark.range(2), "id")).count() == 10
    timed = stream().selectExpr("k", "explode(array(1, 2)) AS copy", "timestamp_ntz'2024-01-01 00:00:00' AS ts").drop("copy")
    assert finish(st.drop_duplicates_within(timed, "ts", "1 hour")).count() == 20
    with pytest.raises(CleaningError):
        st.apply_cell_steps(stream(), [{"action_type": "fill_null", "column": "x", "method": "forward_fill"}])
