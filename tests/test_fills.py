import random

import pytest
from conftest import read

from tablewash.errors import CleaningError
from tablewash.operators import fills


def test_mean(column):
    assert read(fills.fill_mean(column([10.0, 20.0, None, 40.0]), "c"))[2] == pytest.approx(70 / 3)


def test_median(column):
    assert read(fills.fill_median(column([10.0, 20.0, None, 100.0]), "c"))[2] == 20.0


def test_median_treats_nan_as_missing(column):
    assert read(fills.fill_median(column([10.0, 20.0, float("nan"), 100.0]), "c"))[2] == 20.0


def test_median_of_whole_numbers_may_be_fractional(column):
    assert read(fills.fill_median(column([1, 2, None], "bigint"), "c")) == [1.0, 2.0, 1.5]


def test_mean_refuses_text(column):
    with pytest.raises(CleaningError):
        fills.fill_mean(column(["1", None], "string"), "c")


def test_mode_and_its_ties(column):
    assert read(fills.fill_mode(column(["a", "b", "a", None, "a"], "string"), "c"))[3] == "a"
    assert read(fills.fill_mode(column(["b", "a", None], "string"), "c"))[2] == "a"
    with pytest.raises(CleaningError):
        fills.fill_mode(column([None, None], "string"), "c")


def test_constant(column):
    assert read(fills.fill_constant(column([1.0, None, 3.0]), "c", 0)) == [1.0, 0.0, 3.0]
    with pytest.raises(CleaningError):
        fills.fill_constant(column([1.0]), "c", None)
    with pytest.raises(CleaningError):
        fills.fill_constant(column([1.0]), "c", "x")


def test_forward_and_backward(column):
    assert read(fills.fill_forward(column([1.0, None, None, 4.0]), "c", ["k"])) == [1.0, 1.0, 1.0, 4.0]
    assert read(fills.fill_forward(column([None, 2.0, None]), "c", ["k"])) == [2.0, 2.0, 2.0]
    assert read(fills.fill_backward(column([1.0, None, 3.0, None]), "c", ["k"])) == [1.0, 3.0, 3.0, 3.0]
    assert read(fills.fill_forward(column([None, None]), "c", ["k"])) == [None, None]


@pytest.mark.parametrize("cells, expected", [
    (["Emp_1", "Emp_2", None, "Emp_4", "Emp_5"], ["Emp_1", "Emp_2", "Emp_3", "Emp_4", "Emp_5"]),
    (["Employee_000", "Employee_001", None, "Employee_003"], ["Employee_000", "Employee_001", "Employee_002", "Employee_003"]),
    (["A_1", None, None, "A_3"], ["A_1", "A_2", "A_4", "A_3"]),
    (["apple", "banana", None, "cherry"], ["apple", "banana", "Unknown", "cherry"]),
    (["A_1", None, None], ["A_1", "Unknown", "Unknown"]),
    (["A_1", "A_2"], ["A_1", "A_2"]),
    (["A_9", None, None, "A_11"], ["A_9", "A_10", "A_12", "A_11"]),
    (["A_1", "B_5", None], ["A_1", "B_5", "A_2"]),
    (["A_1", "A_1000000000000", None, None], ["A_1", "A_1000000000000", "A_2", "A_3"]),
])
def test_sequential(column, cells, expected):
    assert read(fills.fill_sequential(column(cells, "string"), "c", ["k"])) == expected


def brute_sequential(cells):
    numbers = sorted({int(c[2:]) for c in cells if c})
    free = (n for n in range(numbers[0], 10**6) if n not in set(numbers))
    return [c or f"X_{next(free)}" for c in cells]


@pytest.mark.parametrize("buckets", [1, 7])
def test_sequential_against_brute_force(column, buckets):
    rng = random.Random(3)
    cells = [None if rng.random() < 0.4 else f"X_{rng.randrange(7, 300)}" for _ in range(400)]
    cells += ["X_8", "X_1234"]
    assert read(fills.fill_sequential(column(cells, "string"), "c", ["k"], buckets)) == brute_sequential(cells)


def test_fill_rows_equals_one_fill_after_the_other(spark):
    rng = random.Random(5)
    rows = [(i, None if rng.random() < 0.3 else float(i), None if rng.random() < 0.3 else f"n{i:03d}",
             None if rng.random() < 0.3 else f"m{i}", f"other{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, a double, s string, t string, o string")
    together = fills.fill_rows(df, {"a": "forward"}, ["s", "t"], ["k"], buckets=5)
    apart = fills.fill_sequential(fills.fill_sequential(fills.fill_forward(df, "a", ["k"]), "s", ["k"]), "t", ["k"])
    assert together.columns == df.columns
    assert sorted(together.collect()) == sorted(apart.collect())


def test_no_missing_cell_is_left_if_there_is_a_value(column):
    cells = [None, "x", None, None, "y", None]
    for method in ("mode", "forward_fill", "backward_fill", "sequential"):
        assert None not in read(fills.fill_null(column(cells, "string"), "c", method, order_by=["k"]))


def test_unknown_method(column):
    with pytest.raises(CleaningError):
        fills.fill_null(column([1.0]), "c", "magic")
    with pytest.raises(CleaningError):
        fills.fill_median(column([1.0]), "nothing")
