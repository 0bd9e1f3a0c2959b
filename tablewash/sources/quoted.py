"""CSV files with line breaks in quotes, read by many tasks.

A byte range of such a file does not tell whether it begins inside quotes. Spark's text source cuts
files at line ends into ranges, one task or more for each. The first pass walks the lines of a range once for
both states and gives one small row: where the range ends if it began outside, and if it began
inside quotes. These rows, put together in order, tell the true state at the start of every range.
The second pass then joins lines to records inside each range; only what reaches across a range's
end is put together in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How cells are quoted; the one-task reader is given the same.
OPTIONS = {"quote": '"', "escape": '"'}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the text behind ``line`` is inside quotes, if its start is. A quote opens a cell only
    at the cell's start, and two of them inside a cell stand for one."""
    at = 0
    while True:
        if inside:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if not line.startswith('""', at):
                    break
                at += 2
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Runs of lines of one range, in order; a range may come in several runs."""
    for batch in batches:
        files, starts, lines = (c.to_pylist() for c in batch.columns[:3])
        first = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], starts[i]) != (files[first], starts[first]):
                rest = tuple(c[first].as_py() for c in batch.columns[3:])
                yield (files[first], starts[first], *rest), lines[first:i]
                first = i


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each range of lines begins inside quotes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, list[bool]] = {}
        for key, run in _ranges(batches):
            state = done.setdefault(key, [False, True])
            for line in run:
                if '"' in line:
                    state[:] = [ends_inside(line, s) for s in state]
        if done:
            rows = [(*key, *state) for key, state in done.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "from_outside", "from_inside"])

    ends = lines.mapInArrow(walk, "file string, start long, from_outside boolean, from_inside boolean")
    # A range keeps the state, turns it round, or fixes it. The state before a range is what the last
    # fixing range left, turned round once for each turning range since.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixes, turns = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    turned = F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0))
    here = ends.withColumns({"turned": turned, "turns": turns.cast("int")}).withColumn(
        "fixed", F.when(fixes, F.struct(F.col("from_outside").alias("state"), (F.col("turned") + F.col("turns")).alias("turned"))))
    last = F.last("fixed", ignorenulls=True).over(before)
    since = F.col("turned") - F.coalesce(F.col("last.turned"), F.lit(0))
    return here.withColumn("last", last).select(
        "file", "start", (F.coalesce(F.col("last.state"), F.lit(False)).cast("int") + since).bitwiseAND(1).cast("boolean").alias("inside"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the text of every record; ``first`` marks the first of a file."""
    lines = _lines(spark, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts of a record: 0 whole, 1 begins and goes on in the next range, 2 goes on through a range, 3 ends.
        key, inside, held, part = None, False, [], 0

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        names = ["file", "start", "first", "part", "record"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
        for own, run in _ranges(batches):
            out = []
            if own != key:
                if held:
                    out.append((key[0], key[1], first, 2 if part else 1, "\n".join(held)))
                key, inside, held = own, own[2], []
                part, first = 3 if inside else 0, own[1] == 0
            for line in run:
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    out.append((own[0], own[1], first, part, "\n".join(held)))
                    held, part, first = [], 0, False
            if out:
                yield rows(out)
        if held:
            yield rows([(key[0], key[1], first, 2 if part else 1, "\n".join(held))])

    cuts = lines.join(range_states(lines), ["file", "start"], "left").select("file", "start", "line", "inside").mapInArrow(
        cut, "file string, start long, first boolean, part int, record string")
    whole = cuts.where("part = 0").select("file", "first", "record")
    # Each record that reaches across ranges has one part that begins it.
    number = F.sum((F.col("part") == 1).cast("int")).over(Window.partitionBy("file").orderBy("start", F.col("part") == 1))
    joined = cuts.where("part <> 0").withColumn("number", number).groupBy("file", "number").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"))
    return whole.unionByName(joined.select("file", "first", F.array_join("parts.record", "\n").alias("record")))


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text of a CSV file or folder with a header line, read by many tasks, also where
    cells hold line breaks. Equal to Spark's one-task reader for files whose quotes are in order; a
    file that ends inside quotes has its open record last. Row order is not kept."""
    columns = spark.read.options(header=True, multiLine=True, **OPTIONS).csv(path).columns
    record = F.regexp_replace("record", r"\r$", "")
    rows = quoted_records(spark, path).where("NOT first").select(record.alias("record")).where("record <> ''")
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    cells = rows.select(F.from_csv("record", schema, {**OPTIONS, "multiLine": "true"}).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
