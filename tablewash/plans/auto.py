"""Cleaning a table nobody has described, at one of three levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.errors import CleaningError
from tablewash.functions.text import BOOLEAN_MAP
from tablewash.functions.typing import logical_type, string_columns
from tablewash.operators import cells
from tablewash.operators.detect import cell_signs, detect_dates, detect_identifiers, detect_sequential
from tablewash.operators.fills import fill_rows, fill_value
from tablewash.operators.fits import fit_median
from tablewash.operators.profile import null_counts
from tablewash.operators.rows import drop_duplicates, remove_outliers_all
from tablewash.session import materialize

LEVELS = ("easy", "medium", "hard")


def date_columns(df: DataFrame, order_by: Sequence[str], sample: int | None = None) -> list[str]:
    if not string_columns(df):
        return []
    return [r["column"] for r in detect_dates(df, order_by, sample).where("is_date").collect()]


def auto_clean(
    df: DataFrame, order_by: Sequence[str], level: str = "hard", dates: Sequence[str] | None = None,
    row_id: str | None = None, sample: int | None = None, truth: DataFrame | None = None,
) -> DataFrame:
    """easy: duplicates, missing cells, dates. medium: also stray whitespace, booleans, numbers
    and dates stored as text. hard: also outliers. A ``truth`` given by the caller wins. Decisions
    are taken from whole columns unless a ``sample`` is named. A text column becomes numbers or dates
    if more than 70% of its cells are; ``retype_losses`` tells beforehand what the others are.

    The deduplicated table is written once to the shared folder, because several fits and the
    final plan all start from it.
    """
    if truth is not None:
        return truth
    if level not in LEVELS:
        raise CleaningError(f"unknown level '{level}'; one of {', '.join(LEVELS)}")
    dates = date_columns(df, order_by, sample) if dates is None else list(dates)
    base = materialize(drop_duplicates(df, row_id))
    out = drop_duplicates(_fill(base, order_by, dates, row_id), row_id)
    for c in dates:
        if c in string_columns(out):
            out = cells.to_timestamp_mixed(out, c)
    if level == "easy":
        return out
    out = _retype(materialize(out), order_by, sample)
    if level == "medium":
        return out
    skip = {row_id}
    numbers = [f.name for f in out.schema.fields if logical_type(f.dataType) in ("int", "float") and f.name not in skip]
    return remove_outliers_all(materialize(out), numbers)


def retype_losses(df: DataFrame, order_by: Sequence[str], share: float = 0.7) -> DataFrame:
    """What level medium would leave empty: per text column that it would turn into numbers or dates,
    the cells that do not read as one. (column, target, lost)"""
    numbers, dates = (F.col(c) > F.col("cells") * share for c in ("numbers", "dates"))
    boolean = (F.col("booleans") > 0) & (F.col("variants") <= 10)
    target = F.when(boolean, None).when(numbers, "float").when(dates, "datetime")
    kept = F.when(numbers, F.col("numbers")).otherwise(F.col("dates"))
    return cell_signs(df, order_by).select("column", target.alias("target"), (F.col("cells") - kept).alias("lost")).where(
        "target IS NOT NULL AND lost > 0")


def _fill(df: DataFrame, order_by: Sequence[str], dates: Sequence[str], row_id: str | None) -> DataFrame:
    kinds = {f.name: logical_type(f.dataType) for f in df.schema.fields}
    missing = [r["column"] for r in null_counts(df).where(F.col("nulls") > 0).collect() if r["column"] != row_id]
    numbers = [c for c in missing if kinds[c] in ("int", "float")]
    ordered = [c for c in missing if c in dates]
    texts = [c for c in missing if kinds[c] == "string" and c not in ordered]
    sequential: list[str] = []
    if texts:
        named = {r["column"] for r in detect_identifiers(df, texts).where("is_identifier").collect()}
        running = {r["column"] for r in detect_sequential(df, order_by).where("is_sequential").collect()}
        sequential = [c for c in texts if c in named & running]
    medians = fit_median(df, numbers) if numbers else {}
    constants = {c: "Unknown" for c in texts if c not in sequential}
    filled = fill_rows(df, {c: "forward" for c in ordered}, sequential, order_by)
    out = fill_value(filled, {**medians, **constants})
    return out.select(*df.columns)


def _retype(df: DataFrame, order_by: Sequence[str], sample: int | None) -> DataFrame:
    texts = string_columns(df)
    for c in texts:
        df = cells.strip_whitespace(df, c)
    if not texts:
        return df
    signs = {r["column"]: r for r in cell_signs(df, order_by, texts, sample).collect()}
    booleans = [c for c, s in signs.items() if s["booleans"] > 0 and s["variants"] <= 10]
    # A column becomes boolean only if every cell of it is one; otherwise it stays text.
    whole = {}
    if booleans:
        strange = [F.count_if(~F.col(c).isin(*BOOLEAN_MAP)).alias(c) for c in booleans]
        whole = df.agg(*strange).first().asDict()
    for c in texts:
        s = signs.get(c)
        if s is None:
            continue
        if c in booleans:
            df = cells.to_boolean(df, c, unmapped="keep" if whole[c] else "null")
        elif s["numbers"] > s["cells"] * 0.7:
            df = cells.to_float(df, c)
        elif s["dates"] > s["cells"] * 0.7:
            df = cells.to_timestamp_mixed(df, c)
    return df
