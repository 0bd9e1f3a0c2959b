"""Cell-level steps: narrow projections, except where a step first fits a few parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.functions import parse, text
from tablewash.operators.fits import fit_id_pattern, fit_moments


def _as_text(df: DataFrame, column: str) -> Column:
    require_columns(df, column)
    return F.col(column).cast("string")


def strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.strip(_as_text(df, column)))


def replace_substring(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Replace every occurrence of the literal ``old``; an empty ``new`` deletes it."""
    if not old:
        raise CleaningError("replace_substring needs a non-empty text to look for")
    return df.withColumn(column, F.replace(_as_text(df, column), F.lit(old), F.lit(new)))


def clean_currency(df: DataFrame, column: str) -> DataFrame:
    """'$1,234.56' to 1234.56."""
    return df.withColumn(column, parse.to_float(text.strip_currency(_as_text(df, column)), T.StringType()))


def map_values(
    df: DataFrame, column: str, mapping: Mapping[Any, Any], unmapped: str = "keep"
) -> DataFrame:
    """Map cells by their exact text.

    unmapped: ``keep`` leaves other cells as they are (the column becomes text unless it keeps
    its type), ``null`` drops them and ``error`` fails the job; the latter two give the column
    the type of the mapped values.
    """
    require_columns(df, column)
    if not mapping:
        raise CleaningError("map_values needs a non-empty mapping")
    pairs = [F.lit(v) for k, new in mapping.items() for v in (_cell_text(k), new)]
    found = F.create_map(*pairs)[F.col(column).cast("string")]
    if unmapped == "null":
        return df.withColumn(column, found)
    if unmapped == "error":
        problem = F.raise_error(F.concat(F.lit("no mapping for: "), F.col(column).cast("string")))
        kind = df.select(found.alias("v")).schema["v"].dataType
        other = F.when(F.col(column).isNotNull(), problem.cast(kind))
        return df.withColumn(column, F.coalesce(found, other))
    if unmapped != "keep":
        raise CleaningError(f"unknown choice for unmapped values: '{unmapped}'")
    old_type = df.schema[column].dataType
    new_type = df.select(found.alias("v")).schema["v"].dataType
    if old_type == new_type:
        return df.withColumn(column, F.coalesce(found, F.col(column)))
    shown = F.initcap(found.cast("string")) if isinstance(new_type, T.BooleanType) else found.cast("string")
    return df.withColumn(column, F.coalesce(shown, F.col(column).cast("string")))


def _cell_text(value: Any) -> str:
    """How Spark writes the value as text, so that keys compare with cast cells."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def to_boolean(df: DataFrame, column: str, unmapped: str = "error") -> DataFrame:
    return map_values(df, column, text.BOOLEAN_MAP, unmapped)


def to_float(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, parse.to_float(F.col(column), df.schema[column].dataType))


def to_int(df: DataFrame, column: str, on_fraction: str = "error") -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, parse.to_int(F.col(column), df.schema[column].dataType, on_fraction))


def to_timestamp_mixed(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, parse.to_timestamp_mixed(F.col(column), df.schema[column].dataType))


def to_string(df: DataFrame, column: str) -> DataFrame:
    """Cells as text (see ``cell_text``); a missing cell stays missing."""
    require_columns(df, column)
    dtype = df.schema[column].dataType
    return df.withColumn(column, text.cell_text(parse.missing_nan(F.col(column), dtype), dtype))


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    targets = {"float": to_float, "int": to_int, "datetime": to_timestamp_mixed, "string": to_string}
    if target not in targets:
        raise CleaningError(f"unknown target type '{target}'; one of {', '.join(targets)}")
    return targets[target](df, column)


def standardize_ids(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Rewrite every cell that ends in digits with the most frequent non-empty prefix, padded to
    that prefix's width if it has only one."""
    fit = fit_id_pattern(df, column, order_by, prefer_prefix=True)
    if fit is None or fit.cells < 2:
        return df
    cell = _as_text(df, column)
    digits = text.id_digits(cell)
    number = F.ltrim(digits, F.lit("0"))
    number = F.when(number == "", "0").otherwise(number)
    return df.withColumn(column, F.when(digits != "", text.id_text(fit.prefix, number, fit.width)).otherwise(cell))


def normalize(df: DataFrame, column: str, method: str = "minmax") -> DataFrame:
    """Scale to 0..1 (``minmax``) or to standard scores (``zscore``, sample deviation). A
    constant column becomes 0.0 throughout."""
    require_columns(df, column)
    if method not in ("minmax", "zscore"):
        raise CleaningError(f"unknown normalization '{method}'")
    fit = fit_moments(df, [column])[column]
    return df.withColumn(column, scaled(F.col(column), df.schema[column].dataType, fit, method))


def scaled(c: Column, dtype: T.DataType, fit, method: str) -> Column:
    number = parse.to_float(c, dtype)
    base, span = (fit.min, None) if method == "minmax" else (fit.mean, fit.std)
    if method == "minmax" and fit.count:
        span = fit.max - fit.min
    if span is None:
        return F.lit(None).cast("double")
    if span == 0:
        return F.lit(0.0)
    return (number - F.lit(base)) / F.lit(span)
