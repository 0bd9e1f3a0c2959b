"""Comparing a table before and after a step."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan
from tablewash.operators.profile import duplicate_count, null_counts

MISSING_TEXT = "__NA__"


def _totals(df: DataFrame) -> DataFrame:
    cells = F.lit(0)
    for f in df.schema.fields:
        cells = cells + missing_nan(F.col(f.name), f.dataType).isNull().cast("int")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("nulls"))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, missing cells and duplicates before and after."""
    a = _totals(after).select(F.struct("rows", "nulls")).scalar()
    return _totals(before).select(
        F.lit(True).alias("valid"), F.lit(None).cast("string").alias("error"),
        F.col("rows").alias("rows_before"), a["rows"].alias("rows_after"),
        (F.col("rows") - a["rows"]).alias("rows_removed"),
        F.col("nulls").alias("nulls_before"), a["nulls"].alias("nulls_after"),
        (F.col("nulls") - a["nulls"]).alias("nulls_fixed"),
        duplicate_count(before).scalar().alias("duplicates_before"),
        duplicate_count(after).scalar().alias("duplicates_after"),
    )


def impact_sentence(
    before: DataFrame, after: DataFrame, what: str, column: str | None = None, value: Column | None = None
) -> DataFrame:
    """One row with what a step did, told from both tables: the rows it removed, or with ``column`` the
    cells of it that were filled, and the ``value`` they were filled with."""
    if column is None:
        return impact(before, after).select(F.concat(
            F.lit("Removed "), "rows_removed", F.lit(" of "), "rows_before", F.lit(f" rows {what}")).alias("sentence"))
    here, there = (
        df.agg(F.count_if(missing_nan(F.col(column), df.schema[column].dataType).isNull()).alias("n")) for df in (before, after))
    told = F.concat(F.lit("Filled "), (F.col("n") - there.scalar()).cast("string"), F.lit(f" missing cells of {column} using {what}"))
    return here.select((told if value is None else F.concat(told, F.lit(" "), value.cast("string"))).alias("sentence"))


def dry_run(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` would do, without keeping its result; one row with ``valid = false`` and the
    reason if it cannot be applied."""
    try:
        return impact(df, step(df))
    except CleaningError as problem:
        shape = impact(df, df)
        return df.sparkSession.range(1).select(*[
            F.lit(False).alias("valid") if f.name == "valid"
            else F.lit(str(problem)).alias("error") if f.name == "error"
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in shape.schema.fields
        ])


def null_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns of ``after`` whose number of missing cells changed; a new column had none."""
    old = null_counts(before).select("column", F.col("nulls").alias("nulls_before"))
    new = null_counts(after).select("column", F.col("nulls").alias("nulls_after"))
    return (
        new.join(old, "column", "left")
        .select("column", F.coalesce("nulls_before", F.lit(0)).alias("nulls_before"), "nulls_after")
        .where(F.col("nulls_before") != F.col("nulls_after"))
    )


def changed_cells(
    before: DataFrame, after: DataFrame, key: Sequence[str], per_column: int | None = None, total: int | None = None
) -> DataFrame:
    """Cells that differ between rows with the same key, as text: (keys, column, old, new).
    ``per_column`` and ``total`` make it a report of the first few; the limit per column is
    applied in every task before anything is shuffled for it."""
    require_columns(before, *key)
    require_columns(after, *key)
    columns = [c for c in after.columns if c in before.columns and c not in key]
    def shown(df: DataFrame, c: str):
        return F.coalesce(missing_nan(F.col(c), df.schema[c].dataType).cast("string"), F.lit(MISSING_TEXT))
    old = before.select(*key, *[shown(before, c).alias(f"__o{i}") for i, c in enumerate(columns)])
    new = after.select(*key, *[shown(after, c).alias(f"__n{i}") for i, c in enumerate(columns)])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.col(f"__o{i}").alias("old_value"), F.col(f"__n{i}").alias("new_value"))
        for i, c in enumerate(columns)
    ]
    cells = old.join(new, list(key)).select(*key, F.inline(F.array(*entries)))
    cells = cells.where(F.col("old_value") != F.col("new_value"))
    if per_column is not None:
        place = Window.partitionBy("position").orderBy(*key)
        cells = cells.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= per_column).drop("__r")
    if total is not None:
        cells = cells.orderBy("position", *key).limit(total)
    return cells.drop("position")


#: Buckets of each level of the checksums that two tables are compared by.
BUCKETS = 1024


def _differing(before: DataFrame, after: DataFrame, level: str) -> DataFrame:
    """The buckets of ``level`` whose rows are not the same on both sides."""
    both = before.select(level, "sum", F.lit(-1).alias("side")).union(after.select(level, "sum", F.lit(1).alias("side")))
    balance = both.groupBy(level).agg(F.sum("side").alias("rows"), F.sum(F.col("sum").cast("decimal(20,0)") * F.col("side")).alias("sums"))
    return balance.where("rows <> 0 OR sums <> 0").select(level)


def diff_rows(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """What came, went and changed between two tables with the same columns: the keys, ``change`` (added,
    removed or changed), ``column``, ``old_value`` and ``new_value`` as text. A row that came or went has
    one line for each column, the other side NULL; a changed row one for each cell that differs.

    Rows fall into buckets by their key. Checksums of buckets are compared first, then those of smaller
    buckets inside the differing ones, so rows are only shuffled where something differs, and equal
    tables are read without moving a row. NULL is a key like any other. Equal rows on both sides cancel
    out as counts before keys meet, so a key that many rows share is no hot spot unless they differ;
    the rest of the rows of a key are paired in the order of their cells.
    """
    for df in (before, after):
        require_columns(df, *key)
    columns = [c for c in after.columns if c not in key]
    require_columns(before, *columns)

    def rows(df: DataFrame) -> DataFrame:
        shown = [F.coalesce(missing_nan(F.col(c), df.schema[c].dataType).cast("string"), F.lit(MISSING_TEXT)) for c in columns]
        keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]
        place = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT)) for c in key])
        own = df.select(*keys, F.array(*shown).alias("cells"), place.alias("place"))
        return own.select(
            "*", F.xxhash64("place", "cells").alias("sum"), F.pmod("place", F.lit(BUCKETS)).alias("large"),
            F.struct(F.pmod("place", F.lit(BUCKETS)).alias("large"), F.pmod(F.floor(F.col("place") / BUCKETS), F.lit(BUCKETS)).alias("within")).alias("small"))

    old, new = rows(before), rows(after)
    for level in ("large", "small"):
        # At most a bucket's number each; adaptive execution sees how few they are.
        apart = _differing(old, new, level)
        old, new = old.join(apart, level, "left_semi"), new.join(apart, level, "left_semi")
    names = [f"__k{i}" for i in range(len(key))]
    left = old.select(*names, "cells", F.lit(-1).alias("n")).union(new.select(*names, "cells", F.lit(1).alias("n")))
    left = left.groupBy(*names, "cells").agg(F.sum("n").alias("n")).where("n <> 0")
    left = left.select(*names, "cells", F.col("n").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))).alias("copy"))
    place = Window.partitionBy(*names, F.signum("side")).orderBy("cells", "copy")
    numbered = left.withColumn("nth", F.row_number().over(place))
    pairs = numbered.groupBy(*names, "nth").agg(
        F.max(F.when(F.col("side") < 0, F.col("cells"))).alias("old"), F.max(F.when(F.col("side") > 0, F.col("cells"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.get("old", F.lit(i)).alias("old_value"), F.get("new", F.lit(i)).alias("new_value"))
        for i, c in enumerate(columns)])
    told = pairs.withColumn("change", change).select(
        *[F.col(n).alias(c) for n, c in zip(names, key)], "change",
        F.inline(F.filter(entries, lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))))
    return told


def sample_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """The short report: at most three cells per column and five in all, and only if no rows came
    or went."""
    same = _totals(before).select("rows").scalar() == _totals(after).select("rows").scalar()
    return changed_cells(before, after, key, per_column=3, total=5).where(same)
