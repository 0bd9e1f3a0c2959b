"""Ordered scans over a whole table without putting it into one partition.

``Window.orderBy(k)`` with no ``partitionBy`` moves every row to a single task, and
``Window.partitionBy(g)`` does the same to a group that holds a large share of the rows. Here the
rows are first cut into range buckets of the full key ``(group, order)``. Each bucket is scanned
on its own, and a short table with one row per (group, bucket) carries the state of the earlier
buckets in.

The bucket is found from fixed boundaries, a literal or a written table, so every branch of a plan
and every retried task puts a row into the same bucket. The boundaries only balance the work:
results do not depend on them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewash.errors import CleaningError, require_columns
from tablewash.session import materialize

BUCKET, GROUP = "__bucket", "__group"
CHUNK, SPREAD, BOUNDS = "__chunk", "__spread", "__bounds"
ROWS_PER_BUCKET = 1_000_000
SAMPLES_PER_BUCKET = 16
# Boundaries beyond this number or these bytes are a table instead of a literal.
LITERAL_BUCKETS = 4_096
LITERAL_BYTES = 262_144
# Lengths at which a text boundary may be cut short.
PREFIXES = (8, 32, 128, 512, 2048, 8192)


@dataclass(frozen=True)
class Running:
    """One output column of an ordered scan.

    kind: ``rank``  position within the group, from 0
          ``sum``   running total of ``value``, this row included
          ``max_before``  largest ``value`` of the earlier rows
          ``last``  latest non-null ``value``, this row included
          ``next``  nearest following non-null ``value``, this row included
          ``first`` first non-null ``value`` of the whole group
          ``final`` last non-null ``value`` of the whole group
          ``previous``  ``value`` of the row before, null or not
          ``following`` ``value`` of the row after, null or not
    """

    name: str
    kind: str
    value: Column | None = None


def bucket_count(rows: int, spark) -> int:
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, parallel, math.ceil(rows / ROWS_PER_BUCKET))


def _key(df: DataFrame, names: Sequence[str]) -> Column:
    """The key rows are bucketed by: whole values, so that buckets ascend with the order."""
    return F.col(names[0]) if len(names) == 1 else F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)])


def _boundary(before: Column, key: Column, kind: T.DataType) -> Column:
    """Something short that is above ``before`` and not above ``key``, two neighbouring keys: of the
    first part in which they differ a prefix that tells them apart, and nothing of what follows."""
    if isinstance(kind, T.StringType):
        out = key
        for n in reversed(PREFIXES):
            out = F.when(F.left(before, F.lit(n)) != F.left(key, F.lit(n)), F.left(key, F.lit(n))).otherwise(out)
        return F.when(before.isNull(), key).otherwise(out)
    if not isinstance(kind, T.StructType):
        return key
    out, fields = key, kind.fields
    for i in reversed(range(len(fields))):
        parts = [key[f.name] for f in fields[:i]]
        parts.append(_boundary(before[fields[i].name], key[fields[i].name], fields[i].dataType))
        parts += [F.lit(None).cast(f.dataType) for f in fields[i + 1 :]]
        short = F.struct(*[p.alias(f.name) for p, f in zip(parts, fields)])
        out = F.when(~before[fields[i].name].eqNullSafe(key[fields[i].name]), short).otherwise(out)
    return F.when(before.isNull(), key).otherwise(out)


@dataclass(frozen=True)
class Ranges:
    """Range buckets of the key made of the columns ``names``, fitted on one table and added to any
    table that has these columns. Buckets ascend with the key, and equal keys share a bucket.

    Boundaries that are few and short stand in the plan as ``literal``, a two-level array, so that
    a row is placed with about 2*sqrt(buckets) comparisons. Others are a written ``table`` with one
    row per chunk of ``width`` boundaries; only the first of each chunk (``literal``) stands in the
    plan and tells a row which chunk it meets.
    """

    names: tuple[str, ...]
    schema: str
    width: int = 1
    literal: str | None = None
    table: DataFrame | None = None
    spread: int = 1

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with its bucket in a column of its own."""
        if self.literal is None:
            return df.withColumn(BUCKET, F.lit(0))
        key = _key(df, self.names)
        if self.table is None:
            return df.withColumn(BUCKET, _let(key, self._place).cast("int"))
        heads = F.from_json(F.lit(self.literal), f"array<struct<chunk:int,b:{self.schema}>>")
        chunk = _let(key, lambda k: F.try_element_at(F.filter(heads, lambda h: h["b"] <= k), F.lit(-1))["chunk"])
        rows = df.withColumn(CHUNK, F.coalesce(chunk, F.lit(0)))
        table = self.table
        if self.spread > 1:
            # Too large to be broadcast: each chunk's boundaries serve several partitions of rows.
            rows = rows.withColumn(SPREAD, F.pmod(F.xxhash64(*self.names), F.lit(self.spread)).cast("int"))
            table = table.withColumn(SPREAD, F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))))
        on = [c for c in (CHUNK, SPREAD) if c in table.columns]
        below = F.coalesce(_let(key, lambda k: F.size(F.filter(BOUNDS, lambda b: b <= k))), F.lit(0))
        below = F.when(F.col(BOUNDS).isNotNull(), below).otherwise(0)
        return rows.join(table, on, "left").select(
            *df.columns, (F.col(CHUNK) * self.width + below).cast("int").alias(BUCKET))

    def _place(self, key: Column) -> Column:
        bounds = F.from_json(F.lit(self.literal), f"array<array<{self.schema}>>")
        chunk = F.greatest(F.size(F.filter(bounds, lambda c: F.get(c, F.lit(0)) <= key)) - 1, F.lit(0))
        return _let(chunk, lambda i: i * F.lit(self.width) + F.size(F.filter(F.get(bounds, i), lambda b: b <= key)))


def fit_ranges(
    df: DataFrame, names: Sequence[str], buckets: int | None = None, rows: int | None = None
) -> Ranges:
    """Boundaries from a sample of the keys chosen by hash, of about SAMPLES_PER_BUCKET keys per
    bucket whatever the size of the table. ``rows`` saves the count if it is known. Up to
    LITERAL_BUCKETS buckets whose boundaries take at most LITERAL_BYTES become a literal; beyond
    either the sample is sorted by all tasks and the boundaries are written. Rows are scanned to
    the same results both ways."""
    keys = df.select(_key(df, names).alias("k"))
    if rows is None:
        rows = df.agg(F.count(F.lit(1))).first()[0]
    count = buckets or bucket_count(rows, df.sparkSession)
    kind = keys.schema["k"].dataType
    schema = kind.simpleString()
    if count == 1 or rows == 0:
        return Ranges(tuple(names), schema)
    every = max(1, rows // (count * SAMPLES_PER_BUCKET))
    sample = keys.where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(every)) == 0))
    if count <= LITERAL_BUCKETS:
        width = max(1, math.isqrt(count))
        literal = _literal(sample, kind, count, width)
        if literal in ("[]", "[[]]"):
            return Ranges(tuple(names), schema)
        if literal is not None:
            return Ranges(tuple(names), schema, width, literal)
    return _written(tuple(names), sample, kind, count)


def _literal(sample: DataFrame, kind: T.DataType, count: int, width: int) -> str | None:
    """The boundaries as JSON, chunk by chunk; None if that takes more than LITERAL_BYTES."""
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: _let(
        F.floor(i * F.size("s") / F.lit(count)).cast("int"),
        lambda at: _boundary(F.get("s", at - 1), F.get("s", at), kind))), lambda x: x.isNotNull())
    nested = (
        f"transform(sequence(0, greatest(0, (size(cuts) - 1) div {width})), "
        f"i -> slice(cuts, i * {width} + 1, {width}))"
    )
    text = sample.agg(F.array_sort(F.collect_set("k")).alias("s")).select(cuts.alias("cuts")).selectExpr(
        f"to_json({nested}) as j")
    return text.select(F.when(F.octet_length("j") <= LITERAL_BYTES, F.col("j"))).first()[0]


def _written(names: tuple[str, ...], sample: DataFrame, kind: T.DataType, count: int) -> Ranges:
    """The boundaries as a table. The id of a sorted key holds its partition and its place there, so
    its place among all keys needs the sizes of the partitions only."""
    spark = sample.sparkSession
    keys = materialize(sample.distinct().orderBy("k").select("k", F.monotonically_increasing_id().alias("id")))
    keys = keys.withColumn("part", F.shiftright("id", 33))
    sizes = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = keys.join(sizes, "part").select(
        "k", "total", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("pos"),
        F.lag("k").over(Window.partitionBy("part").orderBy("id")).alias("previous"))
    # Cut i stands at the key of position floor(i * total / count).
    number = F.expr(f"(pos * {count} + total - 1) div total")
    cuts = placed.withColumn("i", number).where(
        (F.col("i") > 0) & (F.col("i") < count) & (F.col("i") * F.col("total") < (F.col("pos") + 1) * count))
    cuts = materialize(cuts.select("i", _boundary(F.col("previous"), F.col("k"), kind).alias("b")))
    size = F.octet_length(F.to_json(F.struct("i", "b")))
    longest, bytes_ = cuts.agg(F.max(size), F.sum(size)).first()
    if longest is None:
        return Ranges(names, kind.simpleString())
    chunks = max(1, min(math.isqrt(count), LITERAL_BYTES // (longest + 24)))
    width = math.ceil(count / chunks)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"])
    table = materialize(cuts.groupBy(F.expr(f"cast(i div {width} as int)").alias(CHUNK)).agg(ordered.alias(BOUNDS)))
    # At most ``chunks`` rows, of LITERAL_BYTES together unless there is but one.
    heads = "[]" if chunks == 1 else table.agg(F.to_json(F.array_sort(F.collect_list(
        F.struct(F.col(CHUNK).alias("chunk"), F.get(BOUNDS, F.lit(0)).alias("b")))))).first()[0]
    fits = bytes_ <= _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return Ranges(names, kind.simpleString(), width, heads, table, 1 if fits else max(2, count // chunks))


def _bytes(text: str) -> int:
    """A size setting in bytes, as ``10MB``, ``10485760b`` or ``-1``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", text.strip().lower()).groups()
    return int(number) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(
    df: DataFrame,
    order_by: Sequence[str],
    outputs: Sequence[Running],
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
    bucket: Column | Ranges | None = None,
) -> DataFrame:
    """Add the ``outputs`` to ``df``, scanning each group of ``partition_by`` in the order of
    ``order_by`` (ascending, nulls first). Together with ``partition_by`` the order columns must
    identify a row; the job fails where two rows share a key. One shuffle of the rows, whatever the number of outputs.

    ``bucket`` may give ranges fitted elsewhere or a bucket expression of the caller's own; it must
    ascend with the key.
    """
    order_by, group = list(order_by), list(partition_by)
    if not order_by:
        raise CleaningError("an ordered scan needs order_by columns")
    require_columns(df, *order_by, *group)
    if bucket is None:
        bucket = fit_ranges(df, group + order_by, buckets)
    # The group as one struct: unlike its columns it is never NULL, so plain equality joins it.
    key = [GROUP, BUCKET] if group else [BUCKET]
    rows = bucket.add(df) if isinstance(bucket, Ranges) else df.withColumn(BUCKET, bucket)
    if group:
        rows = rows.withColumn(GROUP, F.struct(*group))

    # A struct also for one column: it is never NULL, so a row with a NULL key has its place.
    position = F.struct(*order_by)
    summary = rows.groupBy(*key).agg(*[_summary(o, position).alias(o.name) for o in outputs])
    carry = summary.select(
        *[F.col(k).alias(f"{k}_c") for k in key],
        *[_carried(o, key[:-1]).alias(f"__c_{o.name}") for o in outputs],
    )
    # Rows and carried state meet by the key that also partitions the scan, so the rows are
    # shuffled once. Whether the carried side is broadcast is left to its measured size.
    same = [F.col(k) == F.col(f"{k}_c") for k in key]
    joined = rows.join(carry, same, "left")
    window = Window.partitionBy(*key).orderBy(*order_by)
    # Equal keys are in one bucket, next to each other.
    tie = F.lag(position).over(window).eqNullSafe(position)
    told = F.raise_error(F.concat(F.lit("two rows share the order key "), F.to_json(position)))
    scanned = [_scanned(o, key, order_by) for o in outputs]
    scanned = [F.when(tie, told.cast(joined.select(s.alias("s")).schema["s"].dataType)).otherwise(s) for s in scanned[:1]] + scanned[1:]
    return joined.select(*df.columns, *[s.alias(o.name) for s, o in zip(scanned, outputs)])


def _summary(o: Running, position: Column) -> Column:
    """What the later (or earlier) buckets need to know about one bucket."""
    present = F.when(o.value.isNotNull(), position) if o.value is not None else None
    if o.kind == "rank":
        return F.count(F.lit(1))
    if o.kind == "sum":
        return F.sum(o.value)
    if o.kind == "max_before":
        return F.max(o.value)
    if o.kind in ("last", "final"):
        return F.max_by(o.value, present)
    if o.kind in ("next", "first"):
        return F.min_by(o.value, present)
    if o.kind == "previous":
        return F.max_by(F.struct(o.value.alias("v")), position)
    if o.kind == "following":
        return F.min_by(F.struct(o.value.alias("v")), position)
    raise CleaningError(f"unknown running kind '{o.kind}'")


def _carried(o: Running, group: list[str]) -> Column:
    """Combine the summaries of the other buckets of the group: one row per bucket."""
    ordered = Window.partitionBy(*group).orderBy(BUCKET)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # Read backwards: a frame that runs from the current row to the end is recomputed per row.
    later = Window.partitionBy(*group).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = F.col(o.name)
    if o.kind in ("rank", "sum"):
        return F.sum(state).over(earlier)
    if o.kind == "max_before":
        return F.max(state).over(earlier)
    if o.kind in ("last", "previous"):
        return F.last(state, ignorenulls=True).over(earlier)
    if o.kind in ("next", "following"):
        return F.last(state, ignorenulls=True).over(later)
    if o.kind == "final":
        return F.last(state, ignorenulls=True).over(whole)
    return F.first(state, ignorenulls=True).over(whole)


def _scanned(o: Running, key: list[str], order_by: list[str]) -> Column:
    """The scan inside a bucket, joined to what was carried into it."""
    ordered = Window.partitionBy(*key).orderBy(*order_by)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    backwards = [F.col(c).desc_nulls_last() for c in order_by]
    ahead = Window.partitionBy(*key).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.col(f"__c_{o.name}")
    if o.kind == "rank":
        return F.row_number().over(ordered) - 1 + F.coalesce(carried, F.lit(0))
    if o.kind == "sum":
        local = F.sum(o.value).over(so_far)
        return F.when(local.isNotNull() | carried.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)))
    if o.kind == "max_before":
        return F.greatest(F.max(o.value).over(before), carried)
    if o.kind == "last":
        return F.coalesce(F.last(o.value, ignorenulls=True).over(so_far), carried)
    if o.kind == "next":
        return F.coalesce(F.last(o.value, ignorenulls=True).over(ahead), carried)
    if o.kind == "previous":
        return F.coalesce(F.lag(F.struct(o.value.alias("v"))).over(ordered), carried)["v"]
    if o.kind == "following":
        return F.coalesce(F.lead(F.struct(o.value.alias("v"))).over(ordered), carried)["v"]
    return carried
