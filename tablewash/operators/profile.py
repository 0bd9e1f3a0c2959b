"""Profiling: one row per column, from one pass of aggregates, one count of values and exact
quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import require_columns
from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.typing import column_types, logical_type, numeric_columns
from tablewash.operators.quantiles import approx_quantiles, exact_quantiles
from tablewash.sources.tables import TableSet


def _cell(df: DataFrame, name: str) -> Column:
    return missing_nan(F.col(name), df.schema[name].dataType)


def table_shapes(tables: TableSet) -> DataFrame:
    """Rows and columns per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        for name, df in tables.items()
    ]
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logical_schema(df: DataFrame) -> DataFrame:
    """One row per column: its position, name and logical type."""
    entries = [
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
        for i, (n, t) in enumerate(column_types(df).items())
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, from one scan."""
    sums = [F.count_if(_cell(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)
    ]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one. Copies collapse before the shuffle."""
    copies = df.groupBy(*[_cell(df, c).alias(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct non-null value of the columns with its count, in one shuffle of distinct
    values: (col, whole, real, txt, n) with ``col`` the position in ``columns``."""
    require_columns(df, *columns)
    entries = []
    for i, c in enumerate(columns):
        kind, cell = df.schema[c].dataType, _cell(df, c)
        none = F.lit(None)
        whole, real, txt = none.cast("bigint"), none.cast("double"), none.cast("string")
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            whole = cell.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            real = cell.cast("double")
        else:
            txt = cell.cast("string")
        entries.append(F.struct(F.lit(i).alias("col"), whole.alias("whole"), real.alias("real"), txt.alias("txt")))
    cells = df.select(F.inline(F.array(*entries))).where("whole is not null or real is not null or txt is not null")
    return cells.groupBy("col", "whole", "real", "txt").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct and non-null counts and their ratio per column."""
    columns = list(df.columns if columns is None else columns)
    if exact:
        counted = value_counts(df, columns).groupBy("col").agg(
            F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("cells"))
    else:
        parts = [p for i, c in enumerate(columns) for p in (
            F.approx_count_distinct(_cell(df, c)).alias(f"d{i}"), F.count(_cell(df, c)).alias(f"n{i}"))]
        counted = df.agg(*parts).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("col"), F.col(f"d{i}").alias("distinct"), F.col(f"n{i}").alias("cells"))
            for i in range(len(columns))
        ]))).where(F.col("cells") > 0)
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("col"))
    return counted.select(
        name.alias("column"), "distinct", "cells", (F.col("distinct") / F.col("cells")).alias("ratio"))


def _skew(x: Column) -> Column:
    """Bias-corrected skewness: NULL below three values, 0 without variance."""
    n = F.count(x).cast("double")
    corrected = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)
    return F.when(n >= 3, F.when((F.var_pop(x) == 0) | (F.min(x) == F.max(x)), F.lit(0.0)).otherwise(corrected))


def distribution(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles, max and skew of each numeric column (or of
    the numbers in the given columns)."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        schema = "column string, cells bigint, " + ", ".join(
            f"{s} double" for s in ("mean", "std", "min", "q1", "median", "q3", "max", "skew"))
        return df.sparkSession.createDataFrame([], schema)
    quantiles = (exact_quantiles if exact else approx_quantiles)(df, columns)
    # One row per cell and one small set of aggregates: generated code for all columns side by
    # side grows too large to be compiled.
    numbers = df.select(*[
        to_float(F.col(c), df.schema[c].dataType).alias(f"x{i}") for i, c in enumerate(columns)])
    x = F.col("x")
    moments = numbers.unpivot([], numbers.columns, "col", "x").groupBy("col").agg(
        F.count(x).alias("cells"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), _skew(x).alias("skew"))
    known = F.array(*[
        F.struct(F.lit(c).alias("column"), *[
            F.lit(v).cast("double").alias(s) for s, v in zip(("q1", "median", "q3"), quantiles[c])])
        for c in columns
    ])
    place = F.substring("col", 2, 9).cast("int")
    return moments.withColumn("known", F.get(known, place)).select(
        "known.column", "cells", "mean", "std", "min", "known.q1", "known.median", "known.q3", "max", "skew")


def profile_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Everything about each column in one row: type, missing cells, distinct values and, for
    numbers, the distribution; ``duplicates`` and ``rows`` repeat for the table."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    duplicates = duplicate_count(df).scalar()
    return (
        logical_schema(df)
        .join(null_counts(df), "column", "left")
        .join(cardinality(df, exact=exact).select("column", "distinct"), "column", "left")
        .join(distribution(df, exact=exact).drop("cells"), "column", "left")
        .withColumns({"distinct": F.coalesce("distinct", F.lit(0)), "rows": rows, "duplicates": duplicates})
    )


def profile_tables(tables: TableSet, exact: bool = True) -> DataFrame:
    return _union([
        profile_table(df, exact).select(F.lit(name).alias("table"), "*") for name, df in tables.items()
    ])


def compare_distributions(before: DataFrame, after: DataFrame, exact: bool = True) -> DataFrame:
    """Median, mean, deviation and skew of the numeric columns of ``before``, then and now."""
    columns = numeric_columns(before)
    present = [c for c in columns if c in after.columns]
    stats = ("median", "mean", "std", "skew")
    def long(df: DataFrame, names: list[str], label: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias(label)) for s in stats])
        return distribution(df, names, exact).where(F.col("cells") > 0).select("column", F.inline(pairs))
    both = long(before, columns, "before").join(long(after, present, "after"), ["column", "stat"], "full")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def overview(df: DataFrame) -> tuple[int, int, dict[str, int]]:
    """Rows, duplicates and missing cells per column as plain numbers, for choosing steps."""
    sums = [F.count_if(_cell(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    duplicates = duplicate_count(df).first()[0]
    return row["rows"], duplicates, {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


__all__ = [
    "cardinality", "compare_distributions", "distribution", "duplicate_count", "logical_schema", "logical_type",
    "null_counts", "overview", "profile_table", "profile_tables", "table_shapes", "value_counts",
]
