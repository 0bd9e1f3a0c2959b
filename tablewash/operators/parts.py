"""Profiles kept per part of a table, a file or a day, that merge.

A part's state is one row per column: counts, mean and central sums (exact), a HyperLogLog sketch
of its distinct values and a KLL sketch of its numbers. States are a plain table: the union of two
is the state of both, ``merge_parts`` makes coarser parts of finer ones, and ``parts_profile``
reads off the profile. So a table that grows is profiled from its new parts alone.

Exact: rows, nulls, cells, min, max, and (but for rounding) mean, std, skew. Estimated: ``distinct``,
within 5% (three standard errors at the default LG_K), and the quartiles, within 1% of the rows by
rank at the default KLL_K. Repeated rows do not merge and are left to ``duplicate_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.typing import numeric_columns

LG_K = 12
KLL_K = 400
PART = "part"
COUNTS = ("rows", "nulls", "cells", "numbers")


def profile_parts(df: DataFrame, by: Sequence[str] = (), lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """The state of each part, told by the columns ``by``: one pass over the table, one small row per
    part, column and task in the shuffle. A NULL in ``by`` is a part like any other."""
    by, numeric = list(by), set(numeric_columns(df))
    require_columns(df, *by)
    columns = [c for c in df.columns if c not in by]
    clash = {"column", "position", *COUNTS, "mean", "m2", "m3", "min", "max", "values", "ranks"} & set(by)
    if not columns or clash:
        raise CleaningError(f"nothing to profile, or names of the state used in by: {sorted(clash)}")
    entries = []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        cell = missing_nan(F.col(c), kind)
        number = to_float(F.col(c), kind) if c in numeric else F.lit(None).cast("double")
        # xxhash64 gives NULL its seed, so a missing cell must stay NULL.
        entries.append(F.struct(F.lit(i).alias("position"), F.when(cell.isNotNull(), F.xxhash64(cell)).alias("h"), number.alias("x")))
    cells = df.select(*by, F.inline(F.array(*entries)))
    x, n = F.col("x"), F.count("x")
    states = cells.groupBy(*by, "position").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("h").isNull()).alias("nulls"), F.count("h").alias("cells"),
        n.alias("numbers"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"),
        F.when(F.var_pop(x) > 0, F.skewness(x) * n * F.pow(F.var_pop(x), F.lit(1.5))).otherwise(F.lit(0.0)).alias("m3"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.hll_sketch_agg("h", lg_k).alias("values"),
        F.kll_sketch_agg_double(x, kll_k).alias("ranks"))
    return states.withColumn("column", F.get(F.array(*[F.lit(c) for c in columns]), F.col("position")))


def merge_parts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of coarser parts, told by ``by``; by default one part, the whole table."""
    key = [*by, "column"]
    require_columns(parts, *key)
    weight = F.col("numbers")
    # Deviations are taken from the common mean, known first: sums of powers would lose digits.
    grand = parts.groupBy(*key).agg((F.sum(F.col("mean") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("__mean"))
    for k in key:
        grand = grand.withColumnRenamed(k, f"__{k}_g")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}_g"))
    off = F.col("mean") - F.col("__mean")
    return parts.join(grand, same).groupBy(*key).agg(
        F.min("position").alias("position"), *[F.sum(c).alias(c) for c in COUNTS], F.first("__mean").alias("mean"),
        F.sum(F.col("m2") + weight * off * off).alias("m2"),
        F.sum(F.col("m3") + 3 * off * F.col("m2") + weight * off * off * off).alias("m3"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks").alias("ranks"))


def parts_profile(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of the table (or of each part told by ``by``) from the states of its parts."""
    n = F.col("numbers").cast("double")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(F.col("m2") / n, F.lit(1.5))

    # Rounding must not make a spread where there is none.
    one = F.col("min") == F.col("max")

    def quantile(p: float) -> Column:
        return F.when(n > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(p)))

    return merge_parts(parts, by).select(
        *by, "column", "rows", "nulls", "cells", F.hll_sketch_estimate("values").alias("distinct"),
        F.when(one, F.col("min")).otherwise(F.col("mean")).alias("mean"),
        F.when(n > 1, F.when(one, F.lit(0.0)).otherwise(F.sqrt(F.col("m2") / (n - 1)))).alias("std"), "min", quantile(0.25).alias("q1"),
        quantile(0.5).alias("median"), quantile(0.75).alias("q3"), "max",
        F.when(n >= 3, F.when(one | (F.col("m2") == 0), F.lit(0.0)).otherwise(skew)).alias("skew"))


def profile_folder(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The profile of a folder of Parquet files, from states kept in the folder ``state``. Only files
    without a state are read; those that have gone no longer count. Files are taken not to change
    under their name, which holds for what Spark writes."""
    table = spark.read.parquet(folder)
    if PART in table.columns:
        raise CleaningError(f"a column of the table is called '{PART}'")
    files = table.inputFiles()
    try:
        known = {r[0] for r in spark.read.parquet(state).select(PART).distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = set()
    # One way to spell a path: as Spark tells where it read a row.
    new = [f for f in files if f not in known]
    if new:
        rows = spark.read.schema(table.schema).option("basePath", folder).parquet(*new)
        profile_parts(rows.withColumn(PART, F.input_file_name()), [PART]).write.mode("append").parquet(state)
    here = spark.createDataFrame([(f,) for f in files], f"{PART} string")
    return parts_profile(spark.read.parquet(state).join(here, PART, "left_semi"))
