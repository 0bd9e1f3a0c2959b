"""Tables: reading CSV, sets of linked tables, unions and previews."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.errors import CleaningError, require_columns
from tablewash.functions.parse import missing_nan, to_float
from tablewash.functions.text import null_tokens
from tablewash.functions.typing import string_columns
from tablewash.sources.quoted import OPTIONS, read_quoted


@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str

    @classmethod
    def from_dict(cls, d: Mapping[str, str]) -> Relationship:
        return cls(d["from_table"], d["from_column"], d["to_table"], d["to_column"])


@dataclass(frozen=True)
class TableSet(Mapping[str, DataFrame]):
    """Named tables with their links. Immutable: a step gives a new set that shares the rest."""

    tables: Mapping[str, DataFrame]
    relationships: tuple[Relationship, ...] = ()
    primary: str | None = None
    order_by: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CleaningError(f"unknown table '{name}'")
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def with_table(self, name: str, df: DataFrame) -> TableSet:
        if name not in self.tables:
            raise CleaningError(f"unknown table '{name}'")
        return replace(self, tables={**self.tables, name: df})


def read_table(
    spark: SparkSession, path: str, schema: str | None = None, infer: bool = False, one_line: bool = False,
    many_tasks: bool = False,
) -> DataFrame:
    """A CSV file or folder with a header line. All cells are read as text and the usual "not
    available" tokens become NULL; ``infer`` then gives columns of nothing but numbers or
    booleans their type, from one pass over the whole table. With a ``schema`` (DDL) the columns
    are parsed to its types instead, and cells that do not fit become NULL. Quoted cells may hold
    line breaks; where no record does, ``one_line`` lets a large file be read by many tasks, and
    ``many_tasks`` does so where records do, at the price of a second pass over the text."""
    raw = read_quoted(spark, path) if many_tasks else spark.read.options(header=True, multiLine=not one_line, **OPTIONS).csv(path)
    df = raw.select(*[null_tokens(F.col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        wanted = T.StructType.fromDDL(schema)
        require_columns(df, *wanted.names)
        return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    return infer_types(df) if infer else df


def infer_types(df: DataFrame) -> DataFrame:
    """bigint, decimal(38,0), double or boolean for text columns whose every cell reads as one;
    integers beyond 38 digits stay text rather than lose digits."""
    names = string_columns(df)
    parts = []
    for i, c in enumerate(names):
        number = to_float(F.col(c), T.StringType())
        whole = F.when(F.col(c).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.col(c)))
        parts += [
            F.count(F.col(c)).alias(f"n{i}"), F.count(number).alias(f"d{i}"),
            F.count(whole).alias(f"t{i}"), F.count(whole.try_cast("bigint")).alias(f"i{i}"),
            F.count(whole.try_cast("decimal(38,0)")).alias(f"w{i}"),
            F.count(F.when(F.col(c).isin("True", "TRUE", "true", "False", "FALSE", "false"), 1)).alias(f"b{i}"),
        ]
    if not parts:
        return df
    row = df.agg(*parts).first()
    new = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        if not n:
            continue
        if row[f"i{i}"] == n:
            new[c] = F.trim(F.col(c)).cast("bigint")
        elif row[f"w{i}"] == n:
            new[c] = F.trim(F.col(c)).cast("decimal(38,0)")
        elif row[f"t{i}"] == n:
            continue
        elif row[f"d{i}"] == n:
            new[c] = to_float(F.col(c), T.StringType())
        elif row[f"b{i}"] == n:
            new[c] = F.col(c).cast("boolean")
    return df.withColumns(new) if new else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing throughout: floating NaN becomes NULL."""
    return df.select(*[missing_nan(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """A surrogate order key in file order for tables without a key. The values depend on how
    the input is split: write the table out before using them in more than one plan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    require_columns(df, *order_by)
    return df.orderBy(*order_by).limit(max(1, n))


def preview_text(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The preview as text, missing cells shown as 'NULL'."""
    rows = preview(df, order_by, n)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in rows.columns])


def stack_tables(tables: Mapping[str, DataFrame], order_by: Mapping[str, Sequence[str]], n: int = 10) -> DataFrame:
    """The first ``n`` rows of every table under a ``_table`` label, columns united, as text."""
    out = None
    for name, df in tables.items():
        top = df.orderBy(*order_by[name]).limit(n)
        part = top.select(F.lit(name).alias("_table"), *[F.col(c).cast("string").alias(c) for c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise CleaningError("no tables to stack")
    return out.select("_table", *[F.coalesce(F.col(c), F.lit("NULL")).alias(c) for c in out.columns[1:]])
