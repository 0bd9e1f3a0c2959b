"""Finding out what is wrong with an unknown table.

The rules look at all non-null cells of a column, in one scan for all columns; a caller may name a
``sample`` of first cells in the given order instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import to_float, to_timestamp_mixed
from tablewash.functions.text import BOOLEAN_WORDS, id_digits, id_prefix, strip
from tablewash.functions.typing import logical_type, numeric_columns, string_columns
from tablewash.operators.fits import fit_bounds
from tablewash.operators.profile import cardinality, distribution, duplicate_count, null_counts, overview
from tablewash.operators.rows import kept

# Parts of a column name that mark an identifier.
IDENTIFIER_WORDS = ("name", "_id", "identifier", "email", "code")


def _cells(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], sample: int | None) -> DataFrame:
    """(column, cell) as text, the first ``sample`` non-null cells of each column or all."""
    require_columns(df, *columns, *order_by)
    if not columns:
        raise CleaningError("the table has no text column to look at")
    if sample is None:
        entries = [
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns
        ]
        return df.select(F.inline(F.array(*entries))).where(F.col("cell").isNotNull())
    out = None
    for c in columns:
        top = df.where(F.col(c).isNotNull()).orderBy(*order_by).limit(sample)
        part = top.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell"))
        out = part if out is None else out.unionAll(part)
    return out


def cell_signs(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, sample: int | None = None
) -> DataFrame:
    """Per text column: how many of the cells looked at are dates, numbers or padded, whether any
    is a boolean word, and how many different cells there are apart from case."""
    columns = string_columns(df) if columns is None else columns
    cell, text = F.col("cell"), T.StringType()
    lower = F.lower(cell)
    # Equal cells are counted first, so that each is read once.
    different = _cells(df, columns, order_by, sample).groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    def having(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return different.groupBy("column").agg(
        having(F.lit(True)).alias("cells"),
        having(to_timestamp_mixed(cell, text).isNotNull()).alias("dates"),
        having(to_float(cell, text).isNotNull()).alias("numbers"),
        having(cell != strip(cell)).alias("padded"),
        having(lower.isin(*BOOLEAN_WORDS)).alias("booleans"),
        F.count_distinct(lower).alias("variants"),
    )


def detect_dates(df: DataFrame, order_by: Sequence[str], sample: int | None = None, share: float = 0.5) -> DataFrame:
    """Per text column, whether more than ``share`` of its cells read as dates."""
    signs = cell_signs(df, order_by, sample=sample)
    return signs.select("column", (F.col("dates") > F.col("cells") * share).alias("is_date"))


def detect_identifiers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column, whether its name says identifier or more than 80% of its cells differ."""
    columns = list(df.columns if columns is None else columns)
    named = F.lit(False)
    for word in IDENTIFIER_WORDS:
        named = named | F.lower("column").contains(word)
    ratios = cardinality(df, columns, exact).select("column", "ratio")
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(ratios, "column", "left").select(
        "column", (named | F.coalesce(F.col("ratio") > 0.8, F.lit(False))).alias("is_identifier"))


def detect_sequential(df: DataFrame, order_by: Sequence[str], sample: int | None = None, least: int = 3) -> DataFrame:
    """Per text column with at least ``least`` cells, whether one prefix before a number covers half
    of the cells looked at."""
    digits = id_digits(F.col("cell"))
    by_prefix = (
        _cells(df, string_columns(df), order_by, sample)
        .groupBy("column", id_prefix(F.col("cell"), digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    )
    best = by_prefix.groupBy("column").agg(
        F.sum("n").alias("cells"), F.max(F.when(F.col("prefix").isNotNull(), F.col("n"))).alias("top"))
    good = (F.col("cells") >= least) & (F.col("top") >= F.col("cells") * 0.5)
    return best.select("column", F.coalesce(good, F.lit(False)).alias("is_sequential"))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Cells beyond 1.5 IQR per numeric column with ten values and some spread."""
    columns = numeric_columns(df) if columns is None else list(columns)
    bounds = fit_bounds(df, columns, exact=exact) if columns else {}
    columns = [c for c in columns if bounds[c].count >= 10 and bounds[c].spread]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    sums = [F.count_if(~kept(df, c, bounds[c])).alias(f"n{i}") for i, c in enumerate(columns)]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("outliers")) for i, c in enumerate(columns)]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def _issues(signs: DataFrame) -> DataFrame:
    """The text rules: (column, issue, cells) with the number of cells that showed it."""
    half = F.col("cells") * 0.5
    boolean = (F.col("booleans") > 0) & (F.col("variants") <= 10)
    date, number = F.col("dates") > half, F.col("numbers") > half
    found = F.array_compact(F.array(
        F.when(F.col("padded") > 0, F.struct(F.lit("whitespace").alias("issue"), F.col("padded").alias("count"))),
        F.when(boolean, F.struct(F.lit("boolean_like").alias("issue"), F.col("booleans").alias("count"))),
        F.when(date, F.struct(F.lit("date_as_text").alias("issue"), F.col("dates").alias("count")))
        .when(number, F.struct(F.lit("number_as_text").alias("issue"), F.col("numbers").alias("count"))),
    ))
    return signs.select("column", F.inline(found))


def text_issues(df: DataFrame, order_by: Sequence[str], sample: int | None = None) -> DataFrame:
    return _issues(cell_signs(df, order_by, sample=sample))


def analyze_table(
    df: DataFrame, order_by: Sequence[str], sample: int | None = None, exact: bool = True
) -> DataFrame:
    """Every issue found, one row each: (column, issue, count, summary). ``column`` is NULL for
    issues of whole rows."""
    none = F.lit(None).cast("string").alias("column")
    nulls = null_counts(df).where(F.col("nulls") > 0).select(
        "column", F.lit("missing").alias("issue"), F.col("nulls").alias("count"))
    copies = duplicate_count(df).where(F.col("duplicates") > 0).select(
        none, F.lit("duplicates").alias("issue"), F.col("duplicates").alias("count"))
    outliers = outlier_counts(df, exact=exact).where(F.col("outliers") > 0).select(
        "column", F.lit("outliers").alias("issue"), F.col("outliers").alias("count"))
    report = nulls.unionByName(copies).unionByName(outliers)
    if string_columns(df):
        report = report.unionByName(text_issues(df, order_by, sample))
    n = F.col("count").cast("string")
    at = F.concat(F.col("column"), F.lit(": "))
    summary = (
        F.when(F.col("issue") == "missing", F.concat(at, n, F.lit(" missing values")))
        .when(F.col("issue") == "duplicates", F.concat(n, F.lit(" duplicate rows")))
        .when(F.col("issue") == "outliers", F.concat(at, n, F.lit(" outliers (IQR x 1.5)")))
        .when(F.col("issue") == "whitespace", F.concat(at, F.lit("leading or trailing whitespace")))
        .when(F.col("issue") == "boolean_like", F.concat(at, F.lit("booleans in mixed spellings")))
        .when(F.col("issue") == "number_as_text", F.concat(at, F.lit("numbers stored as text")))
        .otherwise(F.concat(at, F.lit("dates stored as text")))
    )
    return report.withColumn("summary", summary)


def describe_columns(
    df: DataFrame, order_by: Sequence[str], level: str = "hard", date_columns: Sequence[str] | None = None
) -> dict[str, str]:
    """A sentence or two per column: what it is and what should be done to it at the given level.
    The wording is what validation rules and step suggestions look for."""
    rows, _, nulls = overview(df)
    texts = string_columns(df)
    signs = {r["column"]: r for r in cell_signs(df, order_by).collect()} if texts else {}
    distinct = {r["column"]: r["distinct"] for r in cardinality(df, texts).collect()} if texts else {}
    identifier = {r["column"]: r["is_identifier"] for r in detect_identifiers(df, texts).collect()} if texts else {}
    sequential = {r["column"]: r["is_sequential"] for r in detect_sequential(df, order_by).collect()} if texts else {}
    numbers = {r["column"]: r for r in distribution(df).collect()}
    outliers = {r["column"]: r["outliers"] for r in outlier_counts(df).collect()} if level == "hard" else {}

    hints = {}
    for field in df.schema.fields:
        c, kind, parts = field.name, logical_type(field.dataType), []
        missing = nulls[c]
        if kind in ("int", "float"):
            stats = numbers.get(c)
            parts.append(
                f"Numeric column, range {stats['min']:.1f} to {stats['max']:.1f}" if stats and stats["cells"]
                else "Numeric column (all values missing)")
            if missing:
                parts.append(f"{missing} missing values: fill with median")
            if outliers.get(c):
                parts.append(f"{outliers[c]} outliers: remove using the IQR method")
        elif kind == "datetime":
            parts.append("Datetime column")
        elif kind == "bool":
            parts.append("Boolean column")
        else:
            parts += _describe_text(signs.get(c), distinct.get(c, 0), level, c in (date_columns or ()))
            is_date = parts[-1].startswith("Dates")
            if missing and is_date:
                parts.append(f"{missing} missing values: use forward fill")
            elif missing and identifier[c] and sequential.get(c):
                parts.append(f"{missing} missing values: fill with the sequential method")
            elif missing:
                parts.append(f"{missing} missing values: fill with constant 'Unknown'")
        hints[c] = ". ".join(parts) + "."
    return hints


def _describe_text(sign, distinct: int, level: str, known_date: bool) -> list[str]:
    fixes_types = level in ("medium", "hard")
    kind = f"Categorical with {distinct} unique values" if 0 < distinct < 20 else f"Text column ({distinct} unique values)"
    if sign is None:
        return [kind]
    parts = []
    if sign["padded"] and fixes_types:
        parts.append("Leading or trailing whitespace: strip it")
    if sign["booleans"] and sign["variants"] <= 10:
        parts.append("Mixed spellings of yes and no: map to boolean" if fixes_types else kind)
    elif sign["numbers"] > sign["cells"] / 2:
        parts.append("Numeric stored as text: convert to float" if fixes_types else kind)
    else:
        parts.append(kind)
    if known_date or sign["dates"] > sign["cells"] * 0.5:
        parts.append("Dates stored as text: convert to datetime")
    return parts
