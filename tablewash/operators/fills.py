"""Filling missing cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan
from tablewash.functions.text import id_digits, id_prefix, id_text
from tablewash.functions.typing import logical_type
from tablewash.operators.fits import IdPattern, fit_id_pattern, fit_median, fit_mode, fit_moments
from tablewash.operators.ordered import Running, bucket_count, fit_ranges, running
from tablewash.session import materialize

PAYLOAD = "__payload"
NEEDY = "__needy"


def fill_value(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Fill with known values, each cast to its column's type. Whole-number columns that get a
    fractional value become double."""
    require_columns(df, *values)
    new = {}
    for c, value in values.items():
        if value is None:
            continue
        dtype = df.schema[c].dataType
        cell = missing_nan(F.col(c), dtype)
        if isinstance(dtype, T.IntegralType) and isinstance(value, float) and not value.is_integer():
            dtype = T.DoubleType()
            cell = cell.cast(dtype)
        fixed = F.lit(value).cast(dtype)
        new[c] = F.coalesce(cell, fixed)
    return df.withColumns(new) if new else df


def _only_numbers(df: DataFrame, columns: Sequence[str], what: str) -> None:
    require_columns(df, *columns)
    for c in columns:
        if logical_type(df.schema[c].dataType) not in ("int", "float"):
            raise CleaningError(f"{what} needs a numeric column; '{c}' is not")


def fill_mean(df: DataFrame, *columns: str) -> DataFrame:
    _only_numbers(df, columns, "fill_mean")
    return fill_value(df, {c: m.mean for c, m in fit_moments(df, columns).items()})


def fill_median(df: DataFrame, *columns: str, exact: bool = True) -> DataFrame:
    _only_numbers(df, columns, "fill_median")
    return fill_value(df, fit_median(df, columns, exact))


def mode_of(df: DataFrame, column: str) -> Any:
    value = fit_mode(df, column)
    if value is None:
        raise CleaningError(f"'{column}' has no value to take a mode of")
    return value


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    return fill_value(df, {column: mode_of(df, column)})


def fill_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    require_columns(df, column)
    if value is None:
        raise CleaningError("fill_constant needs a value")
    target = df.schema[column].dataType
    given = df.select(F.lit(value).alias("v")).schema["v"].dataType
    if logical_type(target) in ("int", "float") and logical_type(given) not in ("int", "float"):
        raise CleaningError(f"cannot fill numeric column '{column}' with {value!r}")
    return fill_value(df, {column: value})


def fill_ordered(
    df: DataFrame, methods: dict[str, str], order_by: Sequence[str],
    partition_by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """Forward or backward fill of several columns in one scan. Where no value comes before (or
    after) a cell, it takes the group's first (or last) value.

    Only rows that lack a cell travel whole; the others send their keys and values as context
    and are kept where they are.
    """
    done, lacking, df = _scan_needy(df, methods, [], order_by, partition_by, buckets)
    return df.where(~lacking).unionByName(done)


def _scan_needy(df, methods, ranked, order_by, partition_by=(), buckets=None):
    """The rows that lack a cell of ``methods`` or ``ranked``, with the former filled and, for
    the latter, the rank of the row among those that lack that cell (``__r0``, ...); the
    condition that picks these rows; and ``df`` with NaN as NULL in those columns."""
    filled_columns = [*methods, *ranked]
    require_columns(df, *filled_columns, *order_by, *partition_by)
    keys = [*partition_by, *order_by]
    if set(keys) & set(filled_columns):
        raise CleaningError("a column cannot be filled along itself")
    outputs = []
    for i, (c, method) in enumerate(methods.items()):
        if method not in ("forward", "backward"):
            raise CleaningError(f"unknown direction '{method}'")
        near, far = ("last", "first") if method == "forward" else ("next", "final")
        outputs += [Running(f"__n{i}", near, F.col(c)), Running(f"__f{i}", far, F.col(c))]
    outputs += [Running(f"__s{j}", "sum", F.col(c).isNull().cast("bigint")) for j, c in enumerate(ranked)]
    lacking = F.lit(False)
    for c in filled_columns:
        df = df.withColumn(c, missing_nan(F.col(c), df.schema[c].dataType))
        lacking = lacking | F.col(c).isNull()
    rest = [c for c in df.columns if c not in keys and c not in filled_columns]
    slim = df.select(*keys, *filled_columns, lacking.alias(NEEDY), *(
        [F.when(lacking, F.struct(*rest)).alias(PAYLOAD)] if rest else []
    ))
    scanned = running(slim, order_by, outputs, partition_by, buckets).where(NEEDY)
    filled = {c: F.coalesce(F.col(c), F.col(f"__n{i}"), F.col(f"__f{i}")) for i, c in enumerate(methods)}
    done = scanned.select(*[
        filled[c].alias(c) if c in filled else F.col(f"{PAYLOAD}.{c}") if c in rest else F.col(c)
        for c in df.columns
    ], *[(F.col(f"__s{j}") - 1).alias(f"__r{j}") for j in range(len(ranked))])
    return done, lacking, df


def fill_forward(df: DataFrame, column: str, order_by: Sequence[str], **kw: Any) -> DataFrame:
    return fill_ordered(df, {column: "forward"}, order_by, **kw)


def fill_backward(df: DataFrame, column: str, order_by: Sequence[str], **kw: Any) -> DataFrame:
    return fill_ordered(df, {column: "backward"}, order_by, **kw)


def _sequence(df: DataFrame, column: str, order_by: Sequence[str]) -> IdPattern | None:
    """The pattern to continue, if one prefix stands on at least half of the cells."""
    fit = fit_id_pattern(df, column, order_by)
    if fit is None or fit.cells < 2 or fit.matches < fit.cells * 0.5:
        return None
    if fit.high is None:
        raise CleaningError(f"the numbers of '{column}' are too long to go on from")
    return fit


def _gaps(df: DataFrame, column: str, fit: IdPattern, buckets: int | None) -> DataFrame:
    """The numbers to hand out as intervals: from rank ``pos`` on, ``first`` and upwards."""
    digits = id_digits(F.col(column))
    numbers = df.where(id_prefix(F.col(column), digits) == fit.prefix).select(
        digits.try_cast("decimal(38,0)").alias("n")).where(F.col("n").isNotNull()).distinct()
    # A number far enough past the largest closes the last interval.
    end = df.sparkSession.range(1).select(F.lit(fit.high + fit.nulls + 1).cast("decimal(38,0)").alias("n"))
    bucket = fit_ranges(numbers, ["n"], buckets, rows=fit.matches)
    steps = running(numbers.unionByName(end), ["n"],
                    [Running("i", "rank"), Running("p", "previous", F.col("n"))], bucket=bucket)
    # Before number p there are (p - low) - (i - 1) missing numbers.
    start = (F.col("p") - F.lit(fit.low) - (F.col("i") - 1)).try_cast("bigint").alias("pos")
    gaps = steps.where(F.col("n") > F.col("p") + 1).select(start, (F.col("p") + 1).alias("first"))
    return gaps.where(F.col("pos") < fit.nulls)


def _hand_out(asking: DataFrame, rank: str, column: str, fit: IdPattern, gaps: DataFrame, buckets: int | None) -> DataFrame:
    """Give each asking row the number of its rank: the latest interval that starts at or before
    it. No range of numbers is spelled out."""
    rest = [c for c in asking.columns if c not in (column, rank)]
    asked = asking.select(F.col(rank).alias("pos"), F.lit(1).alias("kind"),
                          F.lit(None).cast("struct<a:bigint,b:decimal(38,0)>").alias("gap"), F.struct(*rest).alias(PAYLOAD))
    given = gaps.select("pos", F.lit(0).alias("kind"),
                        F.struct(F.col("pos").alias("a"), F.col("first").cast("decimal(38,0)").alias("b")).alias("gap"))
    both = given.unionByName(asked, allowMissingColumns=True)
    # Positions run from 0 to nulls - 1 with at most two rows each: equal cuts are balanced.
    parts = buckets or bucket_count(fit.nulls, asking.sparkSession)
    bucket = F.floor(F.col("pos") * F.lit(parts) / F.lit(fit.nulls)).cast("int")
    matched = running(both, ["pos", "kind"], [Running("at", "last", F.col("gap"))], bucket=bucket)
    number = (F.col("at.b") + F.col("pos") - F.col("at.a")).cast("string")
    return matched.where(F.col("kind") == 1).select(*[
        id_text(fit.prefix, number, fit.width).alias(c) if c == column else F.col(f"{PAYLOAD}.{c}")
        for c in asking.columns if c != rank
    ])


def fill_sequential(
    df: DataFrame, column: str, order_by: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Fill a prefix+number identifier: the k-th missing cell gets the k-th number missing
    between the smallest and the largest, then the numbers after the largest. Without a prefix on
    at least half of the cells, 'Unknown'. Rows that have an identifier never move."""
    require_columns(df, column, *order_by)
    df = df.withColumn(column, F.col(column).cast("string"))
    fit = _sequence(df, column, order_by)
    if fit is None:
        return fill_value(df, {column: "Unknown"})
    if fit.nulls == 0:
        return df
    ranked = running(df.where(F.col(column).isNull()), order_by, [Running("__r0", "rank")], buckets=buckets)
    filled = _hand_out(ranked, "__r0", column, fit, _gaps(df, column, fit, buckets), buckets)
    return df.where(F.col(column).isNotNull()).unionByName(filled)


def fill_rows(
    df: DataFrame, ordered: dict[str, str], sequential: Sequence[str], order_by: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Ordered and sequential fills of different columns with one scan of the row order. All fits
    read ``df`` itself; the rows that lack something are written once, as each sequential column
    goes through them again."""
    if not sequential:
        return fill_ordered(df, ordered, order_by, buckets=buckets) if ordered else df
    if not ordered and len(sequential) == 1:
        return fill_sequential(df, sequential[0], order_by, buckets)
    df = df.withColumns({c: F.col(c).cast("string") for c in sequential})
    fits = {c: _sequence(df, c, order_by) for c in sequential}
    df = fill_value(df, {c: "Unknown" for c, fit in fits.items() if fit is None})
    todo = [c for c, fit in fits.items() if fit is not None and fit.nulls]
    if not todo:
        return fill_ordered(df, ordered, order_by, buckets=buckets) if ordered else df
    done, lacking, df = _scan_needy(df, ordered, todo, order_by, buckets=buckets)
    needy = materialize(done)
    for j, c in enumerate(todo):
        rank = f"__r{j}"
        filled = _hand_out(needy.where(F.col(c).isNull()), rank, c, fits[c], _gaps(df, c, fits[c], buckets), buckets)
        needy = needy.where(F.col(c).isNotNull()).drop(rank).unionByName(filled)
    return df.where(~lacking).unionByName(needy)


def fill_null(
    df: DataFrame, column: str, method: str, value: Any = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Fill one column by the name of a method."""
    if method == "mean":
        return fill_mean(df, column)
    if method == "median":
        return fill_median(df, column)
    if method == "mode":
        return fill_mode(df, column)
    if method == "constant":
        return fill_constant(df, column, value)
    if method in ("forward_fill", "backward_fill"):
        return fill_ordered(df, {column: method.removesuffix("_fill")}, order_by)
    if method == "sequential":
        return fill_sequential(df, column, order_by)
    raise CleaningError(f"unknown fill method '{method}'")
