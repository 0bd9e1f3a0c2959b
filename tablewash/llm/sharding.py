"""Contiguous shards of near equal size from global prefix sums of the row sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.llm.common import fresh, materialize


def contiguous_shards(
    df: DataFrame, size: Column, shards: int, order_by: Sequence[str], shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Cut ``df``, taken in the order of ``order_by``, into ``shards`` runs of near equal total
    ``size`` and add two columns: the shard from 0, and the row's place in it, gapless from 0.

    A row belongs to the shard in which the middle of its span of units falls, so a shard misses
    its target by half a row at each end at most. Only (row, size) are moved, so give a narrow
    ``df`` and join the result where whole rows are needed.

    Rows are dealt to range partitions and written with their partition's number. The totals of
    the partitions, one small row each, give every partition what lies before it; the rest are
    running sums inside partitions. Equal order keys are told apart by the row's place in the
    input, so a key that holds a third of the rows is spread over partitions like any other.

    A NULL or negative size counts as 0. Rows with NULL in ``order_by`` come first. If all sizes
    are 0, all rows are in shard 0. An empty table gives an empty table. Ties and repeated rows
    keep a place each. Columns of any other name are carried along.
    """
    part, tie, unit, at, place, before, rows, total = fresh(
        df.select(*[c for c in df.columns if c not in (shard, slot)]),
        "part", "tie", "unit", "at", "place", "before", "rows", "total")
    keep = [c for c in df.columns if c not in (shard, slot)]
    units = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    # Written before it is dealt: the boundaries are sampled from the narrow rows, not from the input again.
    narrow = materialize(df.withColumns({unit: units, tie: F.monotonically_increasing_id()}))
    dealt = materialize(narrow.repartitionByRange(*order_by, tie).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.groupBy(part).agg(F.sum(unit).alias(unit), F.count(F.lit(1)).alias(rows)).select(
        part,
        F.coalesce(F.sum(unit).over(ahead), F.lit(0)).alias(before),
        F.coalesce(F.sum(rows).over(ahead), F.lit(0)).alias(rows),
        F.sum(unit).over(everything).alias(total),
    )
    inside = Window.partitionBy(part).orderBy(*order_by, tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(unit).over(so_far) - F.col(unit) + F.col(before)
    wide = "decimal(38,0)"
    target = ((F.col(at) * 2 + F.col(unit)).cast(wide) * shards / (F.col(total) * 2).cast(wide)).cast("int")
    cut = materialize(
        dealt.join(totals, part)
        .withColumns({at: start, place: F.row_number().over(inside) - 1 + F.col(rows)})
        .withColumn(shard, F.when(F.col(total) == 0, F.lit(0)).otherwise(F.least(target, F.lit(shards - 1))))
        .select(*keep, place, shard)
    )
    first = cut.groupBy(F.col(shard).alias(part)).agg(F.min(place).alias(before))
    return cut.join(first, F.col(shard) == F.col(part)).select(
        *keep, F.col(shard), (F.col(place) - F.col(before)).alias(slot))
