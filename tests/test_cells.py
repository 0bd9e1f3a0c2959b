import datetime as dt

import pytest
from conftest import read

from tablewash.errors import CleaningError
from tablewash.operators import cells


def test_strip_takes_all_kinds_of_white_space(column):
    messy = [" a ", "\tb\n", " c　", "d e", "", None, "\x1cf\x85"]
    assert read(cells.strip_whitespace(column(messy, "string"), "c")) == ["a", "b", "c", "d e", "", None, "f"]


def test_replace_is_literal(column):
    assert read(cells.replace_substring(column(["$1.$", "a", None], "string"), "c", "$", "")) == ["1.", "a", None]
    assert read(cells.replace_substring(column(["a.b"], "string"), "c", ".", "-")) == ["a-b"]
    with pytest.raises(CleaningError):
        cells.replace_substring(column(["a"], "string"), "c", "", "x")


def test_float(column):
    messy = ["1.5", "abc", " 3 ", "1e3", "+7", "-.5", "inf", "1,234", "$5", "1_000", "12d", "12f", "", None, "nan"]
    none = None
    assert read(cells.to_float(column(messy, "string"), "c")) == [
        1.5, none, 3.0, 1000.0, 7.0, -0.5, float("inf"), none, none, none, none, none, none, none, none]


def test_int(column):
    assert read(cells.to_int(column(["1", "2", "3", "x", None], "string"), "c")) == [1, 2, 3, None, None]
    assert read(cells.to_int(column([1.0, 2.5]), "c", on_fraction="null")) == [1, None]
    with pytest.raises(Exception, match="not a whole number"):
        cells.to_int(column([1.0, 2.5]), "c").collect()


def test_datetime(column):
    messy = ["2023-01-01", "01-Jan-2023", "Jan 1 2023", "2023/01/01", "2023-01-01 06:30:00", "03/04/2020", "25/12/2020",
             "junk", "2023-13-45", "12345", None]
    day = dt.datetime(2023, 1, 1)
    assert read(cells.to_timestamp_mixed(column(messy, "string"), "c")) == [
        day, day, day, day, dt.datetime(2023, 1, 1, 6, 30), dt.datetime(2020, 3, 4), dt.datetime(2020, 12, 25),
        None, None, None, None]


def test_string_keeps_missing(column):
    assert read(cells.to_string(column([1.5, None]), "c")) == ["1.5", None]


def test_unknown_type_and_column(column):
    with pytest.raises(CleaningError):
        cells.convert_type(column([1.0]), "c", "money")
    with pytest.raises(CleaningError):
        cells.convert_type(column([1.0]), "x", "int")


def test_map_values(column):
    df = column(["yes", "No", "maybe", None], "string")
    assert read(cells.map_values(df, "c", {"yes": True, "No": False})) == ["True", "False", "maybe", None]
    assert read(cells.map_values(df, "c", {"yes": "Y"})) == ["Y", "No", "maybe", None]
    assert read(cells.map_values(df, "c", {"yes": True, "No": False}, "null")) == [True, False, None, None]
    assert read(cells.map_values(column([1, 2], "int"), "c", {1: 10})) == [10, 2]
    with pytest.raises(CleaningError):
        cells.map_values(df, "c", {})


def test_boolean_spellings_are_exact(column):
    df = column(["yes", "Yes", "YES", "0", "1", "TRUE", "false", None], "string")
    assert read(cells.to_boolean(df, "c")) == [True, True, True, False, True, True, False, None]
    with pytest.raises(Exception, match="no mapping"):
        cells.to_boolean(column(["yEs"], "string"), "c").collect()


@pytest.mark.parametrize("messy, expected", [
    (["P001", "1", "002", "P003", "x", None], ["P001", "P001", "P002", "P003", "x", None]),
    (["P1", "P10", "7"], ["P1", "P10", "P7"]),                 # several widths: no padding
    (["A01", "B02", "B03", "4"], ["B01", "B02", "B03", "B04"]),
    (["A01", "B02"], ["A01", "A02"]),                          # a tie goes to the first seen
    (["007", "8"], ["7", "8"]),                                # only bare numbers of two widths
    (["P01", "1000"], ["P01", "P1000"]),                       # never cut down to the width
    (["only"], ["only"]),
    ([None, "P1"], [None, "P1"]),
])
def test_standardize(column, messy, expected):
    assert read(cells.standardize_ids(column(messy, "string"), "c", ["k"])) == expected


def test_normalize(column):
    assert read(cells.normalize(column([0.0, 50.0, 100.0]), "c")) == [0.0, 0.5, 1.0]
    assert sum(read(cells.normalize(column([10.0, 20.0, 30.0, 40.0, 50.0]), "c", "zscore"))) == pytest.approx(0)
    assert read(cells.normalize(column([5.0, 5.0, None]), "c")) == [0.0, 0.0, 0.0]
    assert read(cells.normalize(column(["1", "x", "3"], "string"), "c")) == [0.0, None, 1.0]
    assert read(cells.normalize(column([4.0]), "c", "zscore")) == [None]
    with pytest.raises(CleaningError):
        cells.normalize(column([1.0]), "c", "magic")


def test_currency(column):
    assert read(cells.clean_currency(column(["$1,234.56", "7", "", None], "string"), "c")) == [1234.56, 7.0, None, None]


def test_dates_as_the_usual_reader_takes_them(column):
    import pandas as pd

    spelled = ["7/4/99", "7/4/68", "7/4/69", "7/4/2020 3:04 PM", "7/4/2020 12:04 am", "2020-07-04 12:30:15 PM", "Jan 2020", "March 1999",
               "04-Jul-99", "7/4/2020 13:04 PM", "4 Jul 2021 9:00am"]
    want = [pd.to_datetime(x, errors="coerce", format="mixed") for x in spelled[:9]] + [None, pd.Timestamp("2021-07-04 09:00")]
    got = read(cells.to_timestamp_mixed(column(spelled, "string"), "c"))
    assert got == [None if w is None or w is pd.NaT else w.to_pydatetime() for w in want]
