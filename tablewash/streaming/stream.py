"""Steps on Structured Streaming.

Cell-level steps run on a stream as they are. What has to be fitted is fitted on a batch first
and applied with its parameters as literals. Steps that follow the row order of a whole table
have no meaning on a stream and are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.operators.cells import scaled
from tablewash.operators.fills import fill_value
from tablewash.operators.fits import Bounds, Moments
from tablewash.operators.rows import kept
from tablewash.plans.steps import Step, apply_step, as_steps

# Steps that need no fit.
CELL_STEPS = ("strip_whitespace", "map_values", "replace_substring", "convert_type")


def apply_cell_steps(stream: DataFrame, steps: Sequence[Step | Mapping[str, Any]]) -> DataFrame:
    """Cell-level steps and constant fills on a stream."""
    for step in as_steps(steps):
        constant = step.action_type == "fill_null" and step.method == "constant"
        if step.action_type not in CELL_STEPS and not constant:
            raise CleaningError(f"'{step.action_type}' looks at the whole table: fit it on a batch, or use foreachBatch")
        stream = apply_step(stream, step)
    return stream


def apply_fitted(
    stream: DataFrame, fill: Mapping[str, Any] | None = None, bounds: Mapping[str, Bounds] | None = None,
    scale: Mapping[str, Moments] | None = None, method: str = "minmax",
) -> DataFrame:
    """Fill, remove outliers and normalize with parameters fitted on a batch."""
    stream = fill_value(stream, dict(fill or {}))
    for c, b in (bounds or {}).items():
        stream = stream.where(kept(stream, c, b))
    for c, m in (scale or {}).items():
        stream = stream.withColumn(c, scaled(F.col(c), stream.schema[c].dataType, m, method))
    return stream


def drop_duplicates_within(stream: DataFrame, time: str, delay: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop repeated rows that arrive within ``delay`` of each other in event time; state older
    than the watermark is released."""
    require_columns(stream, time, *(columns or ()))
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns or stream.columns))


def keep_known(stream: DataFrame, fk: str, lookup: DataFrame, key: str) -> DataFrame:
    """Drop stream rows whose foreign key has no parent in a static table; rows without one stay."""
    require_columns(stream, fk)
    keys = lookup.where(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    # Rows without a key need no partner: a spread key keeps them from meeting in one partition.
    spread = F.when(F.col(fk).isNull(), F.xxhash64(*stream.columns))
    keys = keys.withColumn("__spread", F.lit(None).cast("bigint"))
    rows = stream.withColumn("__alone", spread).join(
        keys, (F.col(fk) == F.col("__key")) & F.col("__alone").eqNullSafe(F.col("__spread")), "left")
    return rows.where(F.col(fk).isNull() | F.col("__hit")).select(*stream.columns)


def run_available(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Process what is there and stop, appending Parquet to ``path`` (or handing each micro-batch
    to ``each``). Restarting with the same checkpoint goes on where it ended."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format("parquet").outputMode("append").start(path)
    query.awaitTermination()
    return query
