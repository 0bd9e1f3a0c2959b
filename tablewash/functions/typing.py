"""Logical column types and the two compatibility tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def logical_type(dtype: T.DataType) -> str:
    """float, int, string, bool or datetime; anything else is reported as string."""
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in column_types(df).items() if t in ("int", "float")]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def compatible(left: str, right: str, dates_as_text: bool = False) -> bool:
    """Whether two logical types agree. Scoring keeps dates and text apart; validation
    (``dates_as_text=True``) lets a date stand where text was expected and the reverse."""
    families = {"int": "number", "float": "number"}
    left, right = families.get(left, left), families.get(right, right)
    return left == right or (dates_as_text and {left, right} == {"string", "datetime"})
