"""Scoring a table against a reference table.

Columns are compared as sorted lists, position by position. Neither side is ever sorted as a
whole: equal values collapse into one row with its span of positions, and the spans of the two
sides are then matched.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.text import cell_text
from tablewash.functions.typing import column_types, compatible
from tablewash.operators.ordered import BUCKET, Running, bucket_count, fit_ranges, running
from tablewash.operators.profile import duplicate_count
from tablewash.operators.relate import fk_integrity
from tablewash.session import materialize
from tablewash.sources.tables import TableSet

# Weights, tolerances and limits of the scores.
FLOOR = 1e-4
TOLERANCE = 1e-6
MISSING_TEXT = "__NULL__"
CORRECTNESS_WEIGHT, COMPLETENESS_WEIGHT, SCHEMA_WEIGHT = 0.6, 0.3, 0.1
NULL_WEIGHT, DUPLICATE_WEIGHT, TOLERATED_SHARE = 0.6, 0.4, 0.20
TABLES_WEIGHT, FK_WEIGHT = 0.90, 0.10

SCORES = ("correctness", "completeness", "schema_accuracy", "overall")


def clamp(c: Column) -> Column:
    """Into [FLOOR, 1 - FLOOR], to six digits; what is not a number scores FLOOR."""
    inside = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), c))
    return F.round(F.when(c.isNull() | F.isnan(c), F.lit(FLOOR)).otherwise(inside), 6)


@dataclass(frozen=True)
class _Side:
    rows: int
    numbers: dict[str, int]
    nulls: dict[str, int]


def _side(df: DataFrame, columns: list[str]) -> _Side:
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        parts += [F.count(to_float(F.col(c), kind)).alias(f"d{i}"),
                  F.count_if(missing_nan(F.col(c), kind).isNull()).alias(f"n{i}")]
    row = df.agg(*parts).first()
    return _Side(row["rows"], {c: row[f"d{i}"] for i, c in enumerate(columns)},
                 {c: row[f"n{i}"] for i, c in enumerate(columns)})


def _is_numeric(column: str, *sides: _Side) -> bool:
    return all(s.numbers[column] > 0.5 * max(s.rows, 1) for s in sides)


def _values(df: DataFrame, columns: list[str], numeric: set[str], side: str) -> DataFrame:
    """Every cell that takes part in the comparison as (col, x, s, a, b): a number or a text, and
    which side it stands on."""
    entries = []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        col = F.lit(i).alias("col")
        if c in numeric:
            x = to_float(F.col(c), kind)
            entries.append(F.struct(col, x.alias("x"), F.lit(None).cast("string").alias("s")))
        else:
            s = F.coalesce(cell_text(missing_nan(F.col(c), kind), kind), F.lit(MISSING_TEXT))
            entries.append(F.struct(col, F.lit(None).cast("double").alias("x"), s.alias("s")))
    mine, other = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    a, b = (mine, other) if side == "a" else (other, mine)
    cells = df.select(F.inline(F.array(*entries))).where("x is not null or s is not null")
    return cells.withColumns({"a": a, "b": b})


def column_matches(current: DataFrame, truth: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per common column the number of matching positions, at most the rows of the shorter table:
    (column, kind, matches)."""
    columns = [c for c in truth.columns if c in current.columns]
    return _column_matches(current, truth, columns, _side(current, columns), _side(truth, columns), buckets)


def _column_matches(current, truth, columns, cur: _Side, ref: _Side, buckets=None) -> DataFrame:
    spark = current.sparkSession
    shorter = min(cur.rows, ref.rows)
    numeric = {c for c in columns if _is_numeric(c, cur, ref)}
    # Each value once, with its count on both sides; then its span of positions on each side.
    cells = _values(current, columns, numeric, "a").unionByName(_values(truth, columns, numeric, "b"))
    counts = cells.groupBy("col", "x", "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranges = fit_ranges(cells, ["col", "x", "s"], buckets, rows=(cur.rows + ref.rows) * len(columns))
    # Written, as the scan reads its rows twice and each value would be counted and placed again.
    counts = materialize(ranges.add(counts))
    # Written once: the texts and both sides of the walk along the numbers start from here.
    spans = materialize(running(
        counts, ["x", "s"], [Running("ea", "sum", F.col("a")), Running("eb", "sum", F.col("b"))],
        partition_by=["col"], bucket=F.col(BUCKET)).drop(BUCKET))
    start_a, start_b = F.col("ea") - F.col("a"), F.col("eb") - F.col("b")

    text_ids = [i for i, c in enumerate(columns) if c not in numeric]
    number_ids = [i for i, c in enumerate(columns) if c in numeric]
    parts = []
    if text_ids:
        common = F.least("ea", "eb", F.lit(shorter)) - F.greatest(start_a, start_b)
        parts.append(spans.where(F.col("col").isin(text_ids)).groupBy("col").agg(
            F.sum(F.greatest(common, F.lit(0))).alias("matches")))
    if number_ids:
        # Numbers match within a tolerance, so different values can match: walk along the
        # positions at which either side moves on to another value.
        moves = spans.where(F.col("col").isin(number_ids)).select("col", F.inline(F.array(
            F.struct(start_a.alias("pos"), F.when(F.col("a") > 0, F.col("x")).alias("va"), F.lit(None).cast("double").alias("vb")),
            F.struct(start_b.alias("pos"), F.lit(None).cast("double").alias("va"), F.when(F.col("b") > 0, F.col("x")).alias("vb")),
        ))).where("va is not null or vb is not null").groupBy("col", "pos").agg(F.max("va").alias("va"), F.max("vb").alias("vb"))
        longest = max(1, *(max(cur.numbers[columns[i]], ref.numbers[columns[i]]) for i in number_ids))
        cuts = buckets or bucket_count(longest, spark)
        # At most one row per position: equal cuts of the positions are balanced.
        bucket = F.col("col") * cuts + F.floor(F.col("pos") * F.lit(cuts) / F.lit(longest)).cast("int")
        walk = running(moves, ["pos"], [
            Running("na", "last", F.col("va")), Running("nb", "last", F.col("vb")),
            Running("next", "following", F.col("pos")),
        ], partition_by=["col"], bucket=bucket)
        ends = [min(cur.numbers[columns[i]], ref.numbers[columns[i]], shorter) for i in number_ids]
        end = F.element_at(F.create_map(*[F.lit(v) for p in zip(number_ids, ends) for v in p]), F.col("col"))
        upto = F.least(F.coalesce(F.col("next"), end), end)
        length = F.greatest(upto - F.col("pos"), F.lit(0))
        both = [min(cur.rows - cur.numbers[columns[i]], ref.rows - ref.numbers[columns[i]]) for i in number_ids]
        nulls = F.element_at(F.create_map(*[F.lit(v) for p in zip(number_ids, both) for v in p]), F.col("col"))
        near = F.abs(F.col("na") - F.col("nb")) < F.lit(TOLERANCE)
        parts.append(walk.groupBy("col").agg(
            (F.coalesce(F.sum(F.when(near, length)), F.lit(0)) + F.first(nulls)).alias("matches")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("col"))
    kind = F.when(F.col("col").isin(number_ids or [-1]), "number").otherwise("text")
    return out.select(name.alias("column"), kind.alias("kind"),
                      F.least("matches", F.lit(shorter)).cast("bigint").alias("matches"))


def _squared_shortfall(share: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - share / F.lit(TOLERATED_SHARE)), F.lit(2))


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: shares of missing cells and of duplicate rows, and the score made of them."""
    columns = list(columns or df.columns)
    cells = df.select(*columns)
    side = _side(cells, columns)
    return _completeness(cells, side)


def _completeness(cells: DataFrame, side: _Side) -> DataFrame:
    size = max(1, side.rows * len(cells.columns))
    nulls = F.lit(sum(side.nulls.values()) / size)
    copies = F.col("duplicates") / F.lit(max(1, side.rows))
    score = F.lit(NULL_WEIGHT) * _squared_shortfall(nulls) + F.lit(DUPLICATE_WEIGHT) * _squared_shortfall(copies)
    return duplicate_count(cells).select(
        nulls.alias("null_share"), copies.alias("duplicate_share"), score.alias("completeness"))


def schema_accuracy(current: DataFrame, truth: DataFrame) -> float:
    """Share of the common columns with the same or a compatible type."""
    have, want = column_types(current), column_types(truth)
    common = [c for c in want if c in have]
    return sum(compatible(have[c], want[c]) for c in common) / len(common) if common else 0.0


def score_quality(current: DataFrame, truth: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row: correctness, completeness, schema_accuracy and overall."""
    columns = [c for c in truth.columns if c in current.columns]
    cur, ref = _side(current, columns), _side(truth, columns)
    if not columns or not cur.rows or not ref.rows:
        return current.sparkSession.range(1).select(*[F.lit(FLOOR).alias(s) for s in SCORES])
    shorter, longer = min(cur.rows, ref.rows), max(cur.rows, ref.rows)
    matches = _column_matches(current, truth, columns, cur, ref, buckets)
    share = F.sum("matches") / F.lit(shorter * len(columns)) * F.lit(shorter / longer)
    full = _completeness(current.select(*columns), cur).select("completeness").scalar()
    return _graded(matches.agg(share.alias("correctness")).withColumns(
        {"completeness": full, "schema_accuracy": F.lit(schema_accuracy(current, truth))}))


def _graded(raw: DataFrame) -> DataFrame:
    overall = (
        F.lit(CORRECTNESS_WEIGHT) * F.col("correctness") + F.lit(COMPLETENESS_WEIGHT) * F.col("completeness")
        + F.lit(SCHEMA_WEIGHT) * F.col("schema_accuracy")
    )
    return raw.withColumn("overall", overall).select(*[clamp(F.col(s)).alias(s) for s in SCORES])


def score_quality_set(tables: TableSet, truths: Mapping[str, DataFrame]) -> DataFrame:
    """One row over several tables: the mean of their scores, a missing table scoring FLOOR, with
    the share of valid foreign keys in the overall score."""
    each = None
    for name, truth in truths.items():
        if name in tables:
            part = score_quality(tables[name], truth)
        else:
            part = truth.sparkSession.range(1).select(*[F.lit(FLOOR).alias(s) for s in SCORES])
        each = part if each is None else each.unionByName(part)
    links = F.lit(1.0)
    if tables.relationships:
        links = fk_integrity(tables).agg(F.avg("integrity")).scalar()
    mean = each.agg(*[F.avg(s).alias(s) for s in SCORES]).withColumn("fk_integrity", links)
    overall = F.lit(TABLES_WEIGHT) * F.col("overall") + F.lit(FK_WEIGHT) * F.col("fk_integrity")
    return mean.withColumn("overall", overall).select(*[clamp(F.col(s)).alias(s) for s in (*SCORES, "fk_integrity")])


__all__ = [
    "FLOOR", "SCORES", "clamp", "column_matches", "completeness", "schema_accuracy", "score_quality",
    "score_quality_set",
]
