"""Exact quantiles without collecting a column into one task.

``percentile`` keeps every distinct value of a column in the memory of one reducer. Here the
wanted ranks are closed in on instead: the range is cut into cells, rows are counted per cell, and
only the cells that hold a wanted rank are looked into. Long columns start from brackets made of
sketches, so that outliers do not make the cells uneven. Each pass shuffles one row per cell and
task, the last one the values of a few cells. The result is exact, not an estimate.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.errors import require_columns
from tablewash.functions.parse import to_float

CELLS = 1_024             # cells per interval and pass
FINE = 1_000_000          # cells of up to this many rows are looked into
SMALL = 1_000_000         # columns of up to this many values need no sketch
SKETCH_ACCURACY = 2_000   # rank error of a sketch is at most rows / SKETCH_ACCURACY
MARGIN = 0.002            # brackets reach this far to both sides, four times that error
SKETCH_GROUPS = 64        # sketches meet in this many reducers before the last one

Span = tuple[float, float]


@dataclass(frozen=True)
class Cell:
    """Rows of one column between two values, and how many rows lie below."""

    column: int
    low: float
    high: float
    start: int
    size: int


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
    small: int = SMALL, fine: int = FINE,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, NULL and NaN left out; None for an empty column. Any
    number of columns and probabilities share the passes."""
    return {c: q for c, (_, q) in counted_quantiles(df, columns, probs, small, fine).items()}


def counted_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
    small: int = SMALL, fine: int = FINE,
) -> dict[str, tuple[int, list[float | None]]]:
    """Exact quantiles together with the number of values of each column."""
    require_columns(df, *columns)
    if not columns:
        return {}
    table = df.select(*[
        to_float(F.col(c), df.schema[c].dataType).alias(f"x{i}") for i, c in enumerate(columns)])
    whole = _whole(table, len(columns))

    places = {i: [p * (n - 1) for p in probs] for i, (n, _) in enumerate(whole) if n}
    wanted = {i: sorted({r for s in spots for r in (math.floor(s), math.ceil(s))}) for i, spots in places.items()}
    values = _at_ranks(table, whole, wanted, probs, small, fine) if wanted else {}

    out: dict[str, tuple[int, list[float | None]]] = {}
    for i, c in enumerate(columns):
        out[c] = (whole[i][0], [None] * len(probs) if i not in places else [
            _between(values[i, math.floor(s)], values[i, math.ceil(s)], s - math.floor(s)) for s in places[i]])
    return out


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> dict[str, list[float | None]]:
    """One-pass estimates, for callers who do not need exact values."""
    require_columns(df, *columns)
    row = df.agg(*[
        F.percentile_approx(to_float(F.col(c), df.schema[c].dataType), list(probs), 10_000).alias(f"x{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(columns)}


def _between(low: float, high: float, part: float) -> float:
    return low if low == high else low + (high - low) * part


def _whole(table: DataFrame, columns: int) -> list[tuple[int, Span]]:
    """Number of values and range of each column."""
    parts = []
    for i in range(columns):
        x = F.col(f"x{i}")
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
    row = table.agg(*parts).first()
    return [(row[f"n{i}"], (row[f"a{i}"], row[f"z{i}"])) for i in range(columns)]


def _sketched(table: DataFrame, columns: Sequence[int], probs: Sequence[float]) -> dict[int, list[Span]]:
    """Disjoint ascending brackets around the wanted quantiles. A quantile of the whole lies
    between the least and the greatest of the groups' quantiles, so the groups can be sketched
    apart and no reducer merges the sketches of all tasks."""
    low = [max(0.0, p - MARGIN) for p in probs]
    high = [min(1.0, p + MARGIN) for p in probs]
    partial, total = [], []
    for i in columns:
        partial.append(F.percentile_approx(f"x{i}", low + high, SKETCH_ACCURACY).alias(f"q{i}"))
        total += [F.min(F.get(f"q{i}", F.lit(j))).alias(f"l{i}_{j}") for j in range(len(probs))]
        total += [F.max(F.get(f"q{i}", F.lit(j + len(probs)))).alias(f"h{i}_{j}") for j in range(len(probs))]
    grouped = table.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)))
    row = grouped.groupBy("g").agg(*partial).agg(*total).first()
    return {i: _disjoint([(row[f"l{i}_{j}"], row[f"h{i}_{j}"]) for j in range(len(probs))]) for i in columns}


def _disjoint(spans: Sequence[Span]) -> list[Span]:
    out: list[Span] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _at_ranks(table, whole, wanted, probs, small, fine) -> dict[tuple[int, int], float]:
    """The value at every wanted (column, rank)."""
    long = [i for i in wanted if whole[i][0] > small]
    sketched = _sketched(table, long, probs) if long else {}
    spans = {i: sketched.get(i, [whole[i][1]]) for i in wanted}
    found: dict[tuple[int, int], float] = {}
    while True:
        open_cells: dict[Cell, list[int]] = {}
        cells = _count_cells(table, spans)
        for i, ranks in wanted.items():
            if i not in spans:
                continue
            starts = [c.start for c in cells[i]]
            for r in ranks:
                cell = cells[i][bisect_right(starts, r) - 1]
                if cell.low == cell.high:
                    found[i, r] = cell.low
                elif (i, r) not in found:
                    open_cells.setdefault(cell, []).append(r)
        if not open_cells:
            return found
        closer = {i: _disjoint([(c.low, c.high) for c in open_cells if c.column == i]) for i in {c.column for c in open_cells}}
        if max(c.size for c in open_cells) <= fine or closer == spans:
            found.update(_look_into(table, open_cells))
            return found
        spans = closer


def _place(x: Column, spans: Sequence[Span]) -> Column:
    """An ascending cell number: equal parts inside the spans, one cell for each stretch around
    them."""
    cell = None
    for j, (lo, hi) in enumerate(spans):
        base = j * (CELLS + 2)
        part = F.lit(1)
        if hi > lo and math.isfinite(hi - lo):
            part = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(CELLS)), F.lit(CELLS)).cast("int")
        below = x < F.lit(lo)
        cell = F.when(below, F.lit(base)) if cell is None else cell.when(below, F.lit(base))
        cell = cell.when(x <= F.lit(hi), F.lit(base) + part)
    return cell.otherwise(F.lit(len(spans) * (CELLS + 2)))


def _unpivot(table: DataFrame, columns: Sequence[int]) -> DataFrame:
    long = table.select(*[f"x{i}" for i in columns]).unpivot([], [f"x{i}" for i in columns], "col", "x")
    return long.where(F.col("x").isNotNull())


def _by_column(expressions: dict[int, Column]) -> Column:
    out = None
    for i, e in expressions.items():
        mine = F.col("col") == f"x{i}"
        out = F.when(mine, e) if out is None else out.when(mine, e)
    return out


def _count_cells(table: DataFrame, spans: dict[int, list[Span]]) -> dict[int, list[Cell]]:
    """Size and range of every cell: at most a few thousand rows per column."""
    cell = _by_column({i: _place(F.col("x"), s) for i, s in spans.items()})
    rows = (
        _unpivot(table, list(spans)).groupBy("col", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    )
    out: dict[int, list[Cell]] = {i: [] for i in spans}
    upto = dict.fromkeys(spans, 0)
    for row in sorted(rows, key=lambda r: r["cell"]):
        i = int(row["col"][1:])
        out[i].append(Cell(i, row["lo"], row["hi"], upto[i], row["n"]))
        upto[i] += row["n"]
    return out


def _look_into(table: DataFrame, cells: dict[Cell, list[int]]) -> dict[tuple[int, int], float]:
    """Count the values of the given cells one by one and pick those at the wanted ranks."""
    order = list(cells)
    x = F.col("x")
    inside = {
        i: _first_match([(k, (x >= F.lit(c.low)) & (x <= F.lit(c.high))) for k, c in enumerate(order) if c.column == i])
        for i in {c.column for c in order}
    }
    counts = (
        _unpivot(table, sorted(inside)).select(_by_column(inside).alias("cell"), "x").where(F.col("cell").isNotNull())
        .groupBy("cell", "x").agg(F.count(F.lit(1)).alias("n"))
    )
    in_cell = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(in_cell))
    hits = _first_match([
        (1, (F.col("cell") == k) & (F.col("upto") > r - c.start) & (F.col("upto") - F.col("n") <= r - c.start))
        for k, c in enumerate(order) for r in cells[c]
    ])
    out = {}
    for row in ranked.where(hits.isNotNull()).collect():  # a row per wanted rank at most
        c = order[row["cell"]]
        for r in cells[c]:
            if row["upto"] - row["n"] <= r - c.start < row["upto"]:
                out[c.column, r] = row["x"]
    return out


def _first_match(choices: Sequence[tuple[int, Column]]) -> Column:
    out = None
    for value, condition in choices:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out
