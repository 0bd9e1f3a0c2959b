"""Row-level steps: duplicates and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.errors import require_columns
from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.typing import numeric_columns
from tablewash.operators.fits import Bounds, fit_bounds


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Whole-row deduplication, missing equal to missing
    (NaN comes out as NULL). With a surrogate ``row_id`` rows are
    compared without it and the smallest one is kept. Copies collapse before the shuffle, so a
    row repeated any number of times costs one row per task."""
    df = df.select(*[missing_nan(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    if row_id is None:
        return df.distinct()
    require_columns(df, row_id)
    data = [c for c in df.columns if c != row_id]
    return df.groupBy(*data).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def kept(df: DataFrame, column: str, bounds: Bounds) -> Column:
    """Within bounds, or missing, or not a number."""
    if bounds.low is None:
        return F.lit(True)
    x = to_float(F.col(column), df.schema[column].dataType)
    return x.isNull() | ((x >= F.lit(bounds.low)) & (x <= F.lit(bounds.high)))


def remove_outliers(
    df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None, exact: bool = True
) -> DataFrame:
    require_columns(df, column)
    return df.where(kept(df, column, fit_bounds(df, [column], method, threshold, exact)[column]))


def remove_outliers_all(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5, exact: bool = True,
    min_values: int = 10,
) -> DataFrame:
    """IQR removal column after column, each with quartiles of what the columns before it left.
    Columns with fewer than ``min_values`` numbers or no spread are passed over. The bounds are
    literals, so the next fit reads only the columns it needs and can skip by them in the scan."""
    for c in numeric_columns(df) if columns is None else columns:
        bounds = fit_bounds(df, [c], "iqr", threshold, exact)[c]
        if bounds.low is not None and bounds.count >= min_values and (bounds.spread or not min_values):
            df = df.where(kept(df, c, bounds))
    return df
