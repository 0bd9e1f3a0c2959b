"""Checking a cleaned table against rules: one row per rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.typing import column_types, compatible
from tablewash.operators.profile import duplicate_count
from tablewash.operators.quality import clamp
from tablewash.operators.relate import fk_counts
from tablewash.sources.tables import TableSet

# Words in a hint that ask for no missing cells, and the tolerances.
FILL_WORDS = ("missing", "null", "fill")
RANGE_MARGIN, CONSTANT_MARGIN = 0.1, 1.0
ROWS_AT_LEAST, ROWS_AT_MOST = 0.8, 1.2


def _rule(rule: str, column: str | None, passed: Column, violating: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(column).cast("string").alias("column"), passed.alias("passed"),
        violating.cast("bigint").alias("violating"), detail.alias("detail"))


def validate_table(cleaned: DataFrame, truth: DataFrame, hints: Mapping[str, str]) -> DataFrame:
    """(rule, column, passed, violating, detail). The cleaned table is read once for all rules
    but the duplicates."""
    have, want = column_types(cleaned), column_types(truth)
    common = [c for c in want if c in have]
    numeric = [c for c in common if want[c] in ("int", "float")]
    stats = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(numeric):
        x = to_float(F.col(c), truth.schema[c].dataType)
        stats += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
    expected = truth.agg(*stats).first()

    sums = [F.count(F.lit(1)).alias("rows")]
    rules = []
    for i, c in enumerate(cleaned.columns):
        if any(word in hints.get(c, "").lower() for word in FILL_WORDS):
            sums.append(F.count_if(missing_nan(F.col(c), cleaned.schema[c].dataType).isNull()).alias(f"n{i}"))
            n = F.col(f"n{i}")
            rules.append(_rule("NULL_REMAINING", c, n == 0, n, F.concat(n.cast("string"), F.lit(" missing cells"))))
    copies = duplicate_count(cleaned).scalar()
    rules.append(_rule("DUPLICATES", None, copies == 0, copies, F.concat(copies.cast("string"), F.lit(" duplicate rows"))))
    for c in common:
        good = compatible(have[c], want[c], dates_as_text=True)
        rules.append(_rule("TYPE_MISMATCH", c, F.lit(good), F.lit(0), F.lit(f"{have[c]}, expected {want[c]}")))
    for i, c in enumerate(numeric):
        low, high = expected[f"a{i}"], expected[f"z{i}"]
        if low is None:
            continue
        margin = (high - low) * RANGE_MARGIN if high != low else CONSTANT_MARGIN
        x = to_float(F.col(c), cleaned.schema[c].dataType)
        outside = (x < F.lit(low - margin)) | (x > F.lit(high + margin))
        sums += [F.count(x).alias(f"x{i}"), F.count_if(outside).alias(f"o{i}")]
        seen, bad = F.col(f"x{i}") > 0, F.col(f"o{i}")
        span = F.lit(f" cells outside [{low - margin:.1f}, {high + margin:.1f}]")
        rules.append(F.when(seen, _rule("RANGE_VIOLATION", c, bad == 0, bad, F.concat(bad.cast("string"), span)))
                     .otherwise(_rule("RANGE_EMPTY", c, F.lit(False), F.lit(0), F.lit("no numbers"))))
    ratio = F.col("rows") / F.lit(max(expected["rows"], 1))
    rules.append(_rule(
        "ROW_COUNT", None, (ratio >= ROWS_AT_LEAST) & (ratio <= ROWS_AT_MOST), F.lit(0),
        F.concat(F.col("rows").cast("string"), F.lit(f" rows, expected about {expected['rows']}"))))
    return cleaned.agg(*sums).select(F.inline(F.array(*rules)))


def validation_score(report: DataFrame) -> DataFrame:
    """One row: rules passed, rules checked and the clamped share."""
    return report.agg(
        F.count_if("passed").alias("rules_passed"), F.count(F.lit(1)).alias("rules_total"),
        clamp(F.coalesce(F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))).alias("validation_score"))


def validate_tables(
    tables: TableSet, truths: Mapping[str, DataFrame], hints: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """The rules of every truth table, one failed rule per missing table, and one rule per foreign
    key: (table, rule, column, passed, violating, detail)."""
    parts = []
    for name, truth in truths.items():
        if name in tables:
            report = validate_table(tables[name], truth, hints.get(name, {}))
        else:
            report = _single(truth, "MISSING_TABLE", None, f"table '{name}' not found")
        parts.append(report.select(F.lit(name).alias("table"), "*"))
    for r in tables.relationships:
        parts.append(_link_rule(tables, r).select(F.lit(r.from_table).alias("table"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _single(df: DataFrame, rule: str, column: str | None, detail: str) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.inline(F.array(_rule(rule, column, F.lit(False), F.lit(0), F.lit(detail)))))


def _link_rule(tables: TableSet, r) -> DataFrame:
    some = next(iter(tables.values()))
    if r.from_table not in tables or r.to_table not in tables:
        return _single(some, "FK_MISSING_TABLE", r.from_column, f"{r.from_table} or {r.to_table} is missing")
    child, parent = tables[r.from_table], tables[r.to_table]
    if r.from_column not in child.columns or r.to_column not in parent.columns:
        return _single(some, "FK_MISSING_COLUMN", r.from_column, f"{r.from_column} or {r.to_column} is missing")
    bad = F.col("child_rows") - F.col("matched_rows")
    detail = F.concat(bad.cast("string"), F.lit(f" values not in {r.to_table}.{r.to_column}"))
    return fk_counts(child, r.from_column, parent, r.to_column).select(
        F.inline(F.array(_rule("FK_VIOLATION", r.from_column, bad == 0, bad, detail))))
