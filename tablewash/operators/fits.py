"""Fits: one job each, returning a handful of numbers. The parameters then stand as literals in
the plan that applies them, where filters on them can reach the file scan, and they can be reused
on a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.text import id_digits, id_prefix
from tablewash.operators.quantiles import approx_quantiles, counted_quantiles, exact_quantiles


@dataclass(frozen=True)
class Moments:
    count: int
    min: float | None
    max: float | None
    mean: float | None
    std: float | None


@dataclass(frozen=True)
class Bounds:
    """Values to keep; ``low`` is None where nothing is to be removed."""

    low: float | None
    high: float | None
    count: int = 0
    spread: float | None = None


@dataclass(frozen=True)
class IdPattern:
    prefix: str
    width: int       # pad to this many digits, 0 for no padding
    matches: int     # cells with this prefix
    cells: int       # non-null cells
    nulls: int
    low: int | None
    high: int | None


def _number(df: DataFrame, column: str):
    return to_float(F.col(column), df.schema[column].dataType)


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Count, range, mean and sample deviation of all columns in one pass."""
    require_columns(df, *columns)
    parts = []
    for i, c in enumerate(columns):
        x = _number(df, c)
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"),
                  F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*parts).first()
    return {
        c: Moments(row[f"n{i}"], row[f"a{i}"], row[f"z{i}"], row[f"m{i}"], row[f"s{i}"])
        for i, c in enumerate(columns)
    }


def fit_median(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    quantiles = exact_quantiles if exact else approx_quantiles
    return {c: q[0] for c, q in quantiles(df, columns, (0.5,)).items()}


def fit_mode(df: DataFrame, column: str) -> Any:
    """The most frequent value, the smallest on ties; None if there is none. Counted per value
    first, so a value that fills a third of the table is one row by the time it is compared."""
    require_columns(df, column)
    value = missing_nan(F.col(column), df.schema[column].dataType).alias("v")
    best = (
        df.select(value).where(F.col("v").isNotNull())
        .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best"))
    )
    row = best.select("best.v").first()
    return row["v"]


def fit_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr",
    threshold: float | None = None, exact: bool = True,
) -> dict[str, Bounds]:
    """Outlier bounds: quartiles -/+ threshold * IQR (default 1.5) or mean -/+ threshold *
    deviation (default 3)."""
    if method == "iqr":
        t = 1.5 if threshold is None else threshold
        if exact:
            fitted = counted_quantiles(df, columns, (0.25, 0.75))
        else:
            counts = fit_moments(df, columns)
            fitted = {c: (counts[c].count, q) for c, q in approx_quantiles(df, columns, (0.25, 0.75)).items()}
        return {
            c: Bounds(None, None) if q1 is None
            else Bounds(q1 - t * (q3 - q1), q3 + t * (q3 - q1), count, q3 - q1)
            for c, (count, (q1, q3)) in fitted.items()
        }
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        return {
            c: Bounds(None, None, m.count, m.std) if not m.std
            else Bounds(m.mean - t * m.std, m.mean + t * m.std, m.count, m.std)
            for c, m in fit_moments(df, columns).items()
        }
    raise CleaningError(f"unknown outlier method '{method}'; one of iqr, zscore")


def fit_id_pattern(
    df: DataFrame, column: str, order_by: Sequence[str], prefer_prefix: bool = False
) -> IdPattern | None:
    """The most frequent prefix in front of a trailing number; on ties the one seen first in
    ``order_by``. ``prefer_prefix`` takes the empty prefix only if there is no other. None if no
    cell ends in digits."""
    require_columns(df, column, *order_by)
    cell = F.col(column).cast("string")
    parts = df.select(cell.alias("cell"), *order_by).withColumn("digits", id_digits(F.col("cell")))
    parts = parts.withColumn("prefix", id_prefix(F.col("cell"), F.col("digits")))
    place = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    number = F.col("digits").try_cast("decimal(38,0)")
    by_prefix = parts.groupBy("prefix", F.col("cell").isNull().alias("missing")).agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"),
        F.min(F.length("digits")).alias("w0"), F.max(F.length("digits")).alias("w1"),
        F.min(number).alias("lo"), F.max(number).alias("hi"),
    )
    named = (F.col("prefix") != "").cast("int") if prefer_prefix else F.lit(0)
    rank = F.struct(-named, -F.col("n"), F.col("seen"))
    found = F.col("prefix").isNotNull()
    row = by_prefix.agg(
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("missing"), 0).otherwise(F.col("n"))).alias("cells"),
        F.min_by(F.struct("prefix", "n", "w0", "w1", "lo", "hi"), F.when(found, rank)).alias("best"),
    ).first()
    if row["best"] is None:
        return None
    best = row["best"]
    width = best["w0"] if best["w0"] == best["w1"] else 0
    return IdPattern(best["prefix"], width, best["n"], row["cells"], row["nulls"],
                     *((best["lo"], best["hi"]) if best["w1"] <= 38 else (None, None)))
