"""Steps across linked tables.

Joins carry no broadcast hint: adaptive execution looks at the real size of the key side and
broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``; beyond it the sort-merge join
splits hot keys. Rows that need no partner get a key of their own instead of all meeting in one
partition as NULL keys would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.errors import CleaningError, require_columns
from tablewash.sources.tables import Relationship, TableSet

SPREAD = 1_024


def _spread(active: Column, columns: Sequence[str]) -> Column:
    """0 for rows that take part in a join, otherwise one of SPREAD values by the row's content."""
    return F.when(active, F.lit(0)).otherwise(F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int") + 1)


def lookup_fill(
    df: DataFrame, column: str, fk: str, lookup: DataFrame, key: str, value: str, order_by: Sequence[str]
) -> DataFrame:
    """Fill missing cells of ``column`` from ``lookup``. For a repeated key the first row in
    ``order_by`` counts, even if its value is missing; without an order a repeated key fails the job,
    as there is no first row."""
    require_columns(df, column, fk)
    require_columns(lookup, key, value, *order_by)
    rows = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
    if order_by:
        place = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
        hits = rows.agg(F.min_by(F.struct(F.col(value).alias("v")), place).alias("__hit"))
    else:
        problem = F.concat(F.lit("no order is given for the rows that share the key "), F.col("__key").cast("string"))
        hit = F.struct(F.col(value).alias("v"))
        hits = rows.agg(F.any_value(hit).alias("__one"), F.count(F.lit(1)).alias("__n")).select(
            "__key", F.when(F.col("__n") == 1, F.col("__one")).otherwise(F.raise_error(problem)).alias("__hit"))
    first = (
        hits
        .select("__key", F.col("__hit.v").alias("__value"), F.lit(0).alias("__zero"))
    )
    asks = F.col(column).isNull() & F.col(fk).isNotNull()
    left = df.withColumns({"__fk": F.when(asks, F.col(fk)), "__spread": _spread(asks, df.columns)})
    joined = left.join(first, (F.col("__fk") == F.col("__key")) & (F.col("__spread") == F.col("__zero")), "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col("__value").cast(df.schema[c].dataType)).alias(c) if c == column else F.col(c)
        for c in df.columns
    ])


def _marked(df: DataFrame, fk: str, lookup: DataFrame, key: str) -> DataFrame:
    """``df`` with a ``__hit`` column that is set where the foreign key has a parent."""
    require_columns(df, fk)
    require_columns(lookup, key)
    keys = lookup.where(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct()
    keys = keys.withColumns({"__hit": F.lit(True), "__zero": F.lit(0)})
    left = df.withColumn("__spread", _spread(F.col(fk).isNotNull(), df.columns))
    return left.join(keys, (F.col(fk) == F.col("__key")) & (F.col("__spread") == F.col("__zero")), "left")


def enforce_fk(df: DataFrame, fk: str, lookup: DataFrame, key: str) -> DataFrame:
    """Drop rows whose foreign key has no parent; rows without a foreign key stay."""
    rows = _marked(df, fk, lookup, key)
    return rows.where(F.col(fk).isNull() | F.col("__hit")).select(*df.columns)


def fk_orphans(df: DataFrame, fk: str, lookup: DataFrame, key: str) -> DataFrame:
    """The rows whose foreign key has no parent."""
    require_columns(df, fk)
    require_columns(lookup, key)
    keys = lookup.select(F.col(key).alias("__key")).distinct()
    return df.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__key"), "left_anti")


def fk_counts(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: child rows with a foreign key, and how many of them have a parent. Children are
    counted per key before the join, so no key is hot in it."""
    per_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__fk")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return per_key.join(keys, F.col("__fk") == F.col("__key"), "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("n"))), F.lit(0)).alias("matched_rows"),
    )


def _linked(tables: TableSet, r: Relationship) -> bool:
    return (
        r.from_table in tables and r.to_table in tables
        and r.from_column in tables[r.from_table].columns and r.to_column in tables[r.to_table].columns
    )


def fk_integrity(tables: TableSet) -> DataFrame:
    """One row per relationship with its share of matched child rows: 0 where a table or column
    is lacking, 1 where no child row has a key."""
    spark = tables.spark
    parts = []
    for r in tables.relationships:
        name = F.lit(f"{r.from_table}.{r.from_column}").alias("relationship")
        if _linked(tables, r):
            counts = fk_counts(tables[r.from_table], r.from_column, tables[r.to_table], r.to_column)
            share = F.when(F.col("child_rows") == 0, F.lit(1.0)).otherwise(F.col("matched_rows") / F.col("child_rows"))
            parts.append(counts.select(name, "child_rows", "matched_rows", share.alias("integrity")))
        else:
            zero = F.lit(0).cast("bigint")
            parts.append(spark.range(1).select(
                name, zero.alias("child_rows"), zero.alias("matched_rows"), F.lit(0.0).alias("integrity")))
    if not parts:
        raise CleaningError("the table set has no relationships")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fk_integrity_score(tables: TableSet) -> float:
    """Mean over the relationships, 1 if there are none."""
    if not tables.relationships:
        return 1.0
    return fk_integrity(tables).agg(F.avg("integrity")).first()[0]
