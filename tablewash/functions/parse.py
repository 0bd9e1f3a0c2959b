"""Parsing cells into numbers, timestamps and booleans. Nothing here raises under ANSI mode
except where a function says so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.text import strip

# Fixed value: what counts as a number. Spark's own cast would also take "12d" and "12f".
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"

# Date spellings as (shape, parse pattern), tried in this order. A cheap shape
# test comes first so that no parser is entered for a cell it cannot read. Month-first wins
# over day-first when both fit. Two digits of a year are of the century that brings it nearest:
# less than AHEAD years ahead of today, or else a hundred years before.
_WORD = "[A-Za-z]{3,9}"
DATE_SHAPES = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"),
    (r"(1[789]|2[01])\d{6}", "yyyyMMdd"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (rf"\d{{1,2}} {_WORD} \d{{4}}", "d MMMM yyyy"),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", "MMM d yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (rf"{_WORD} \d{{1,2}} \d{{4}}", "MMMM d yyyy"),
    (rf"{_WORD} \d{{1,2}}, \d{{4}}", "MMMM d, yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "M.d.yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{2}", "d-MMM-yy"),
    (r"[A-Za-z]{3} \d{4}", "MMM yyyy"),
    (rf"{_WORD} \d{{4}}", "MMMM yyyy"),
    (r"(1[789]|2[01])\d{2}", "yyyy"),
)
#: A time of day behind a date, and a zone behind that; a moment with a zone is turned to UTC.
TIME_OF_DAY = r"[ T](\d{1,2}:\d{2}(?::\d{2}(?:[.]\d{1,6})?)?(?: ?[AaPp][Mm])?)"
AHEAD = 50
ZONE = r" ?(Z|[+-]\d{2}:?\d{2})"
#: One test that every readable cell passes, so that most others are let go after it.
MOMENT = rf"^(?:{'|'.join(dict.fromkeys(shape for shape, _ in DATE_SHAPES))})(?:{TIME_OF_DAY}(?:{ZONE})?)?$"


def missing_nan(c: Column, dtype: T.DataType) -> Column:
    """NaN and NULL are one kind of missing; only floating columns can hold NaN."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def to_float(c: Column, dtype: T.DataType) -> Column:
    """A double, or NULL where the cell is not a number."""
    if isinstance(dtype, T.StringType):
        is_number = c.rlike(NUMBER_PATTERN) | c.rlike(INFINITY_PATTERN)
        return F.when(is_number, F.btrim(c, F.lit(" \t\n\x0b\x0c\r")).try_cast("double"))
    if isinstance(dtype, T.NumericType):
        return missing_nan(c.cast("double"), T.DoubleType())
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    return F.lit(None).cast("double")


def to_int(c: Column, dtype: T.DataType, on_fraction: str = "error") -> Column:
    """A bigint. A fractional number fails the job, or becomes NULL on request: a plain cast
    would cut it without a word."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    number = to_float(c, dtype)
    exact = F.when(number == F.floor(number).cast("double"), number.try_cast("bigint"))
    if isinstance(dtype, T.StringType):
        # Digits are read as they stand: a double would round them beyond 2 ** 53.
        digits = F.when(c.rlike(INTEGER_PATTERN), F.btrim(c, F.lit(" \t\n\x0b\x0c\r")))
        exact = F.when(digits.isNotNull(), digits.try_cast("bigint")).otherwise(exact)
    elif isinstance(dtype, T.DecimalType):
        exact = F.when(c == F.floor(c), c.try_cast("bigint"))
    if on_fraction == "null":
        return exact
    problem = F.concat(F.lit("not a whole number: "), number.cast("string"))
    return F.when(number.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.coalesce(exact, F.raise_error(problem).cast("bigint"))
    )


def _in_century(moment: Column, pattern: str) -> Column:
    if pattern.count("y") != 2:
        return moment
    return F.when(F.year(moment) >= F.year(F.current_date()) + AHEAD, moment - F.make_ym_interval(F.lit(100))).otherwise(moment)


def to_timestamp_mixed(c: Column, dtype: T.DataType) -> Column:
    """A timestamp read cell by cell from the known spellings, or NULL."""
    if isinstance(dtype, T.TimestampType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    return _let(strip(c), lambda cell: F.when(
        cell.rlike(MOMENT), F.when(F.contains(cell, F.lit(":")), _timed(cell)).otherwise(_day(cell))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _day(day: Column) -> Column:
    return F.coalesce(*[
        F.when(day.rlike(f"^{shape}$"), _in_century(F.try_to_timestamp(day, F.lit(pattern)), pattern)) for shape, pattern in DATE_SHAPES])


def _timed(cell: Column) -> Column:
    """Date, time and zone are read apart: any date spelling may have any time behind it."""
    behind = rf"{TIME_OF_DAY}(?:{ZONE})?$"
    date = _let(F.regexp_replace(cell, behind, ""), _day)
    zone = F.regexp_extract(cell, behind, 2)
    return _let(F.regexp_extract(cell, behind, 1), lambda clock: F.when(clock == "", date).otherwise(_at_clock(date, clock, zone)))


def _at_clock(date: Column, clock: Column, zone: Column) -> Column:
    # Of twelve hours: 12 AM is 0, and PM adds 12 to all but 12. Hours beyond 12 have no half of the day.
    half, hour = F.lower(F.right(clock, F.lit(2))), F.regexp_extract(clock, r"^\d{1,2}", 0).cast("int")
    twelve = F.when(hour.between(1, 12), F.format_string("%02d", hour % 12 + F.when(half == "pm", 12).otherwise(0)))
    clock = F.when(half.isin("am", "pm"), F.concat(twelve, F.regexp_extract(clock, r"(:[\d:.]+)", 1))).otherwise(clock)
    timed = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), clock, F.regexp_replace(zone, r"(\d{2})(\d{2})$", "$1:$2"))
    return timed.try_cast("timestamp")
