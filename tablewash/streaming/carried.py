"""Forward fill along a stream.

A cell takes the last value before it, whichever micro-batch that came in. Between batches a folder
keeps the last value and the last order key of each group, and the rows that wait because their
group has had no value yet; they leave with the group's first value, as in a batch.

Batch ``n`` reads what the batches before it left and writes parts of its own, the state last, each
replacing what an earlier try of the same batch has written. So a batch that is run again, after a
crash at any point, gives the same rows. Its part of the state holds only the groups it touched;
every ``compact_every`` batches a part holds all of them, so no batch reads more parts than that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan
from tablewash.operators.ordered import GROUP, Running, running
from tablewash.session import materialize

ERA, VALUE, TOP, BATCH = "__era", "__value", "__top", "__batch"
CARRIED, ARRIVED = 0, 1


@dataclass(frozen=True)
class ForwardFill:
    """Fills ``column`` along ``order_by`` within ``partition_by``, for ``foreachBatch`` (or
    ``run_available``'s ``each``). ``folder`` must be one that all executors can reach, and belong to
    this stream and its checkpoint alone. A row whose order key does not lie behind what its group
    had in earlier batches fails the batch; so do equal keys within one."""

    schema: T.StructType
    column: str
    order_by: Sequence[str]
    partition_by: Sequence[str] = ()
    folder: str = ""
    compact_every: int = 20

    def __post_init__(self):
        missing = [c for c in (self.column, *self.order_by, *self.partition_by) if c not in self.schema.names]
        if missing or not self.order_by or not self.folder:
            raise CleaningError(f"a fill along a stream needs a folder, order_by and known columns; missing: {missing}")
        if self.column in (*self.order_by, *self.partition_by):
            raise CleaningError("a column cannot be filled along itself")

    def __call__(self, batch: DataFrame, number: int) -> None:
        require_columns(batch, *self.schema.names)
        spark = batch.sparkSession
        arrived = materialize(self._grouped(batch.select(*self.schema.names)))
        touched = arrived.select(GROUP).distinct()
        before = self._state(spark, number)
        mine = before.join(touched, GROUP, "left_semi")
        scanned = materialize(self._scan(arrived, mine))

        value = F.coalesce(F.col(self.column), F.col("__last"), F.col("__first"))
        own = scanned.where(F.col(ERA) == ARRIVED)
        done = own.withColumn(self.column, value).where(F.col(self.column).isNotNull())
        # Groups that had rows but no value until now let go of what waited.
        opened = scanned.where((F.col(ERA) == CARRIED) & F.col(self.column).isNull() & F.col("__first").isNotNull()).select(
            GROUP, F.col("__first").alias(VALUE))
        waited = self._waiting(spark, number)
        freed = waited.join(opened, GROUP).withColumn(self.column, F.col(VALUE))
        names = self.schema.names
        self._write(done.select(*names).unionByName(freed.select(*names)), "out", number)

        waiting = own.where(value.isNull()).select(*names, GROUP, F.lit(number).cast("bigint").alias(BATCH))
        position = F.struct(ERA, *self.order_by)
        state = scanned.groupBy(GROUP).agg(
            F.max_by(F.struct(F.coalesce(F.col(self.column), F.col("__last")).alias("v")), position)["v"].alias(VALUE),
            F.max(F.coalesce(TOP, F.struct(*self.order_by))).alias(TOP)).withColumn(BATCH, F.lit(number).cast("bigint"))
        if number % self.compact_every == 0:
            state = state.unionByName(before.join(touched, GROUP, "left_anti"))
            waiting = waiting.unionByName(waited.join(opened, GROUP, "left_anti"))
        self._write(waiting, "waiting", number)
        self._write(state, "state", number)

    def filled(self, spark: SparkSession, rest: bool = False) -> DataFrame:
        """The rows of all finished batches that have a value or, with ``rest``, all rows, those that
        still wait among them with NULL."""
        numbers = self._finished(spark)
        out = self._read(spark, "out", self.schema, numbers)
        if not rest:
            return out
        return out.unionByName(self._waiting(spark, max(numbers, default=-1) + 1).select(*self.schema.names))

    def _grouped(self, df: DataFrame) -> DataFrame:
        """With the group as one struct, which is never NULL; a stream without groups is one."""
        cell = missing_nan(F.col(self.column), self.schema[self.column].dataType)
        key = [F.col(c) for c in self.partition_by] or [F.lit(0).alias("all")]
        return df.withColumn(self.column, cell).withColumn(GROUP, F.struct(*key))

    def _scan(self, arrived: DataFrame, before: DataFrame) -> DataFrame:
        """One scan over what was carried (a row per group, first) and what arrived."""
        kind = arrived.schema[self.column].dataType
        carried = before.select(
            F.col(GROUP).alias("__g"), F.col(VALUE).cast(kind).alias(self.column), TOP, F.lit(CARRIED).alias(ERA))
        rows = arrived.withColumnRenamed(GROUP, "__g").withColumns({TOP: F.lit(None).cast(before.schema[TOP].dataType), ERA: F.lit(ARRIVED)})
        both = rows.unionByName(carried, allowMissingColumns=True)
        scanned = running(both, [ERA, *self.order_by], [
            Running("__last", "last", F.col(self.column)), Running("__first", "first", F.col(self.column)),
            Running("__until", "first", F.col(TOP))], partition_by=["__g"])
        position = F.struct(*self.order_by)
        late = (F.col(ERA) == ARRIVED) & (position <= F.col("__until"))
        told = F.raise_error(F.concat(F.lit("a row came behind a later one of its group: "), F.to_json(position)))
        return scanned.withColumn(ERA, F.when(late, told.cast("int")).otherwise(F.col(ERA))).withColumnRenamed("__g", GROUP)

    def _state_schema(self) -> T.StructType:
        top = T.StructType([T.StructField(c, self.schema[c].dataType) for c in self.order_by])
        return T.StructType([
            T.StructField(GROUP, self._group_type()), T.StructField(VALUE, self.schema[self.column].dataType),
            T.StructField(TOP, top), T.StructField(BATCH, T.LongType())])

    def _group_type(self) -> T.StructType:
        fields = [T.StructField(c, self.schema[c].dataType) for c in self.partition_by]
        return T.StructType(fields or [T.StructField("all", T.IntegerType())])

    def _parts(self, number: int) -> range:
        """The batches whose parts hold the state before batch ``number``: back to the latest whole one."""
        return range(max(0, (number - 1) // self.compact_every * self.compact_every), number)

    def _state(self, spark: SparkSession, number: int) -> DataFrame:
        parts = self._read(spark, "state", self._state_schema(), self._parts(number))
        latest = F.max_by(F.struct(VALUE, TOP, BATCH), BATCH).alias("s")
        return parts.groupBy(GROUP).agg(latest).select(GROUP, "s.*")

    def _waiting(self, spark: SparkSession, number: int) -> DataFrame:
        """The rows that wait before batch ``number``: those of groups still without a value."""
        schema = T.StructType([*self.schema.fields, T.StructField(GROUP, self._group_type()), T.StructField(BATCH, T.LongType())])
        rows = self._read(spark, "waiting", schema, self._parts(number))
        valued = self._state(spark, number).where(F.col(VALUE).isNotNull())
        return rows.join(valued.select(GROUP), GROUP, "left_anti").select(*schema.names)

    def _path(self, what: str, number: int) -> str:
        return f"{self.folder.rstrip('/')}/{what}/{number:09d}"

    def _write(self, df: DataFrame, what: str, number: int) -> None:
        df.write.mode("overwrite").parquet(self._path(what, number))

    def _read(self, spark: SparkSession, what: str, schema: T.StructType, numbers: Sequence[int]) -> DataFrame:
        paths = [self._path(what, n) for n in numbers]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _finished(self, spark: SparkSession) -> list[int]:
        """Batches whose state, which is written last, is complete."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/state/*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])
