"""Queries for profiling, detection and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewash.operators import cells, detect, diff, fills, parts, profile, rows
from tablewash.operators.fits import fit_median
from tablewash.sources.tables import TableSet
from tablewash.workloads.messy import oracle, table, view
from tablewash.workloads.registry import query
from tablewash.workloads.steps_queries import DATES, IS_NUMBER, SPACES

ORDER_COLUMNS = ("k", "cust", "price", "status", "reading", "priority", "amount", "number_text", "date_text",
                 "year_text", "day_text", "flag", "id_text", "spike")
ORDER_NUMBERS = ("k", "cust", "price", "reading", "spike")
ORDER_TEXTS = tuple(c for c in ORDER_COLUMNS if c not in ORDER_NUMBERS)
STATS = ("mean", "std", "min", "q1", "median", "q3", "max", "skew")


def _per_column(columns, sql: str) -> str:
    return "\nUNION ALL ".join(sql.replace("{c}", c) for c in columns)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


# --- profiles -------------------------------------------------------------------------------

@query("prof_shapes", oracle("orders_twice customers_messy", """
SELECT 'orders' AS "table", count(*) AS rows, 14 AS columns FROM orders_twice
UNION ALL SELECT 'customers', count(*), 7 FROM customers_messy
UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem"""))
def prof_shapes(spark, folder):
    return profile.table_shapes(TableSet({
        "orders": view(spark, folder, "orders_twice"), "customers": view(spark, folder, "customers_messy"),
        "lineitem": table(spark, folder, "lineitem")}))


@query("prof_schema", """
SELECT ordinal_position - 1 AS position, column_name AS "column",
  CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float'
       WHEN data_type = 'BOOLEAN' THEN 'bool' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END AS type
FROM (SELECT cid + 1 AS ordinal_position, name AS column_name, type AS data_type FROM pragma_table_info('lineitem'))""")
def prof_schema(spark, folder):
    return profile.logical_schema(table(spark, folder, "lineitem"))


@query("prof_nulls", oracle("orders_messy", _per_column(
    ORDER_COLUMNS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM orders_messy")))
def prof_nulls(spark, folder):
    return profile.null_counts(view(spark, folder, "orders_messy"))


@query("prof_duplicates", oracle("orders_twice", """
SELECT (SELECT count(*) FROM orders_twice) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_twice)) AS duplicates"""))
def prof_duplicates(spark, folder):
    return profile.duplicate_count(view(spark, folder, "orders_twice"))


@query("prof_duplicates_text", """
SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents""")
def prof_duplicates_text(spark, folder):
    return profile.duplicate_count(table(spark, folder, "documents").select("text"))


_MEAN_STD = "SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM "


@query("prof_mean_std", oracle("orders_messy", _per_column(ORDER_NUMBERS, _MEAN_STD + "orders_messy")))
def prof_mean_std(spark, folder):
    df = view(spark, folder, "orders_messy")
    return _rounded(profile.distribution(df, exact=False).select("column", "mean", "std"), "mean", "std")


_DISTRIBUTION = """SELECT '{c}' AS "column", count({c}) AS cells, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
 round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max,
 round(skewness({c}), 4) AS skew FROM """


@query("prof_distribution", oracle("orders_messy", _per_column(ORDER_NUMBERS, _DISTRIBUTION + "orders_messy")))
def prof_distribution(spark, folder):
    return _rounded(profile.distribution(view(spark, folder, "orders_messy")), *STATS)


_ITEMS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("prof_lineitem", _per_column(_ITEMS, _DISTRIBUTION + "lineitem"))
def prof_lineitem(spark, folder):
    return _rounded(profile.distribution(table(spark, folder, "lineitem")), *STATS)


_CUSTOMER_COLUMNS = (("k", True), ("name", False), ("contact", False), ("nation", True), ("balance", True),
                     ("segment", False), ("email", False))


def _profile_sql(name: str, label: str, columns) -> str:
    parts = []
    for c, number in columns:
        stats = ", ".join(
            (f"round({e.format(c=c)}, 4)" if number else "CAST(NULL AS DOUBLE)") + f" AS {s}" for s, e in zip(STATS, (
                "avg({c})", "stddev_samp({c})", "min({c})", "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.5)",
                "quantile_cont({c}, 0.75)", "max({c})", "skewness({c})")))
        parts.append(f"""SELECT '{label}' AS "table", '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
          count(DISTINCT {c}) AS "distinct", (SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}))
          AS duplicates, {stats} FROM {name}""")
    return "\nUNION ALL ".join(parts)


@query("prof_multi", oracle("customers_twice orders_twice", _profile_sql("customers_twice", "customers", _CUSTOMER_COLUMNS)
       + "\nUNION ALL " + _profile_sql("orders_twice", "orders", [(c, c in ORDER_NUMBERS) for c in ORDER_COLUMNS])))
def prof_multi(spark, folder):
    tables = TableSet({"customers": view(spark, folder, "customers_twice"), "orders": view(spark, folder, "orders_twice")})
    return _rounded(profile.profile_tables(tables).drop("position", "type"), *STATS)


@query("prof_merged_parts", oracle("orders_messy", _per_column(ORDER_NUMBERS, """
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count({c}) AS cells, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(skewness({c}), 4) AS skew FROM orders_messy""")))
def prof_merged_parts(spark, folder):
    """Days are profiled on their own, merged into months, and months into the whole."""
    orders = view(spark, folder, "orders_messy").select("k", F.substring("day_text", 1, 10).alias("day"), *ORDER_NUMBERS[1:])
    days = parts.profile_parts(orders, ["day"])
    months = parts.merge_parts(days.withColumn("month", F.substring("day", 1, 7)), ["month"])
    return _rounded(parts.parts_profile(months), "mean", "std", "skew").select(
        "column", "rows", "nulls", "cells", "mean", "std", "min", "max", "skew")


@query("prof_cardinality", oracle("orders_messy", _per_column(ORDER_COLUMNS, """SELECT '{c}' AS "column",
  count(DISTINCT {c}) AS "distinct", count({c}) AS cells, round(count(DISTINCT {c}) / count({c}), 6) AS ratio FROM orders_messy""")))
def prof_cardinality(spark, folder):
    return profile.cardinality(view(spark, folder, "orders_messy")).withColumn("ratio", F.round("ratio", 6))


@query("prof_cardinality_text", """
SELECT 'text' AS "column", count(DISTINCT text) AS "distinct", count(text) AS cells,
  round(count(DISTINCT text) / count(text), 6) AS ratio FROM documents
UNION ALL SELECT 'source', count(DISTINCT source), count(source), round(count(DISTINCT source) / count(source), 6) FROM documents""")
def prof_cardinality_text(spark, folder):
    return profile.cardinality(table(spark, folder, "documents"), ["text", "source"]).withColumn("ratio", F.round("ratio", 6))


# --- detection ------------------------------------------------------------------------------

_FIRST = """
, cells AS (""" + _per_column(ORDER_TEXTS, """
  SELECT '{c}' AS "column", {c} AS cell, row_number() OVER (ORDER BY k) AS r FROM orders_messy WHERE {c} IS NOT NULL""") + ")"
_SIGNS = _FIRST + f""",
signs AS (SELECT "column", count(*) AS cells,
  count(CASE WHEN regexp_full_match(cell, '(1[789]|2[01])\\d\\d') THEN 1 END) + count(try_strptime(trim(cell, {SPACES}), {DATES})) AS dates,
  count(CASE WHEN {IS_NUMBER.format(c='cell')} THEN 1 END) AS numbers,
  count(CASE WHEN cell <> trim(cell, {SPACES}) THEN 1 END) AS padded,
  count(CASE WHEN lower(cell) IN ('yes', 'no', 'true', 'false', '1', '0') THEN 1 END) AS booleans,
  count(DISTINCT lower(cell)) AS variants FROM cells GROUP BY "column")
"""


@query("detect_dates", oracle("orders_messy", _SIGNS + 'SELECT "column", dates > cells * 0.5 AS is_date FROM signs'))
def detect_dates(spark, folder):
    return detect.detect_dates(view(spark, folder, "orders_messy"), ["k"])


@query("detect_cell_signs", oracle("orders_messy", _SIGNS + "SELECT * FROM signs"))
def detect_cell_signs(spark, folder):
    return detect.cell_signs(view(spark, folder, "orders_messy"), ["k"])


@query("detect_cell_signs_full", oracle("orders_messy", _SIGNS + "SELECT * FROM signs"))
def detect_cell_signs_full(spark, folder):
    return detect.cell_signs(view(spark, folder, "orders_messy"), ["k"], sample=None)


@query("detect_identifiers", oracle("customers_messy", _per_column([c for c, _ in _CUSTOMER_COLUMNS], """
SELECT '{c}' AS "column", regexp_matches('{c}', 'name|_id|identifier|email|code')
  OR coalesce(count(DISTINCT {c}) / count({c}) > 0.8, false) AS is_identifier FROM customers_messy""")))
def detect_identifiers(spark, folder):
    return detect.detect_identifiers(view(spark, folder, "customers_messy"))


@query("detect_sequential", oracle("orders_messy", _FIRST + r""",
parts AS (SELECT *, regexp_extract(cell, '([0-9]+)$', 1) AS digits FROM cells),
groups AS (SELECT "column", CASE WHEN digits <> '' THEN left(cell, length(cell) - length(digits)) END AS prefix, count(*) AS n
           FROM parts GROUP BY 1, 2)
SELECT "column", coalesce(sum(n) >= 3 AND max(CASE WHEN prefix IS NOT NULL THEN n END) >= sum(n) * 0.5, false) AS is_sequential
FROM groups GROUP BY "column" """))
def detect_sequential(spark, folder):
    return detect.detect_sequential(view(spark, folder, "orders_messy"), ["k"])


_ISSUES = """
SELECT "column", 'whitespace' AS issue, padded AS count FROM signs WHERE padded > 0
UNION ALL SELECT "column", 'boolean_like', booleans FROM signs WHERE booleans > 0 AND variants <= 10
UNION ALL SELECT "column", 'date_as_text', dates FROM signs WHERE dates > cells * 0.5
UNION ALL SELECT "column", 'number_as_text', numbers FROM signs WHERE dates <= cells * 0.5 AND numbers > cells * 0.5"""


def _issue(name: str, wanted: str):
    sql = f"SELECT \"column\", issue, count FROM ({_ISSUES}) WHERE issue = '{wanted}'"

    @query(name, oracle("orders_messy", _SIGNS + sql))
    def run(spark, folder):
        found = detect.text_issues(view(spark, folder, "orders_messy"), ["k"])
        return found.where(F.col("issue") == wanted)
    return run


_issue("detect_whitespace", "whitespace")
_issue("detect_boolean", "boolean_like")
_issue("detect_numeric_strings", "number_as_text")
_issue("detect_date_strings", "date_as_text")

_OUTLIERS = _per_column(ORDER_NUMBERS, """
SELECT '{c}' AS "column", (SELECT count(*) FROM orders_messy, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
  FROM orders_messy) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers""")


@query("detect_outliers", oracle("orders_messy", _OUTLIERS))
def detect_outliers(spark, folder):
    return detect.outlier_counts(view(spark, folder, "orders_messy"))


@query("detect_issue_report", oracle("orders_messy orders_twice", _SIGNS.replace("orders_messy", "orders_twice")
       + _ISSUES + "\nUNION ALL SELECT \"column\", 'outliers', outliers FROM (" + _OUTLIERS.replace("orders_messy", "orders_twice")
       + ") WHERE outliers > 0\nUNION ALL SELECT \"column\", 'missing', nulls FROM (" + _per_column(
           ORDER_COLUMNS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM orders_twice")
       + ") WHERE nulls > 0\nUNION ALL SELECT NULL, 'duplicates', (SELECT count(*) FROM orders_twice) "
         "- (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_twice))"))
def detect_issue_report(spark, folder):
    return detect.analyze_table(view(spark, folder, "orders_twice"), ["k"]).drop("summary")


@query("describe_columns")
def describe_columns(spark, folder):
    hints = detect.describe_columns(view(spark, folder, "orders_twice"), ["k"])
    return spark.createDataFrame(list(hints.items()), "column string, hint string")


# --- before and after -----------------------------------------------------------------------

def _cleaned(spark, folder):
    return rows.remove_outliers(fills.fill_median(view(spark, folder, "orders_twice"), "price", "reading"), "spike")


_CLEANED = """
, q AS (SELECT median(price) AS mp, median(reading) AS mr, quantile_cont(spike, 0.25) AS q1, quantile_cont(spike, 0.75) AS q3 FROM orders_twice),
cleaned AS (SELECT o.* REPLACE (coalesce(price, mp) AS price, coalesce(reading, mr) AS reading) FROM orders_twice o, q
            WHERE spike BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
"""
_FOUR = (("median", "median({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("skew", "skewness({c})"))


@query("diff_distribution", oracle("orders_messy orders_twice", _CLEANED + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{s}' AS stat, round(b, 4) AS before, round(a, 4) AS after, round(a - b, 4) AS delta
    FROM (SELECT {e.format(c=c)} AS b FROM orders_twice), (SELECT {e.format(c=c)} AS a FROM cleaned)"""
    for c in ORDER_NUMBERS for s, e in _FOUR)))
def diff_distribution(spark, folder):
    compared = profile.compare_distributions(view(spark, folder, "orders_twice"), _cleaned(spark, folder))
    return _rounded(compared, "before", "after", "delta")


_NULLS = " + ".join(f"(count(*) - count({c}))" for c in ORDER_COLUMNS)


@query("diff_preview", oracle("orders_messy orders_twice", _CLEANED + f"""
SELECT true AS valid, CAST(NULL AS VARCHAR) AS error, b.rows AS rows_before, a.rows AS rows_after, b.rows - a.rows AS rows_removed,
  b.nulls AS nulls_before, a.nulls AS nulls_after, b.nulls - a.nulls AS nulls_fixed,
  b.rows - b.kinds AS duplicates_before, a.rows - a.kinds AS duplicates_after
FROM (SELECT count(*) AS rows, {_NULLS} AS nulls, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_twice)) AS kinds FROM orders_twice) b,
     (SELECT count(*) AS rows, {_NULLS} AS nulls, (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS kinds FROM cleaned) a"""))
def diff_preview(spark, folder):
    df = view(spark, folder, "orders_twice")
    return diff.dry_run(df, lambda _: _cleaned(spark, folder))


@query("diff_nulls", oracle("orders_messy orders_twice", _CLEANED + "SELECT * FROM (" + _per_column(ORDER_COLUMNS, """
SELECT '{c}' AS "column", (SELECT count(*) - count({c}) FROM orders_twice) AS nulls_before,
  (SELECT count(*) - count({c}) FROM cleaned) AS nulls_after""") + ") WHERE nulls_before <> nulls_after"))
def diff_nulls(spark, folder):
    return diff.null_changes(view(spark, folder, "orders_twice"), _cleaned(spark, folder))


def _edited(spark, folder):
    df = view(spark, folder, "orders_messy")
    df = cells.replace_substring(cells.strip_whitespace(df, "priority"), "amount", "$", "")
    return fills.fill_constant(fills.fill_constant(df, "status", "Unknown"), "price", 0)


_EDITED = """
, edits AS (SELECT k, 1 AS position, 'price' AS "column", coalesce(CAST(price AS VARCHAR), '__NA__') AS old_value,
    coalesce(CAST(price AS VARCHAR), '0.0') AS new_value FROM orders_messy
  UNION ALL SELECT k, 2, 'status', coalesce(status, '__NA__'), coalesce(status, 'Unknown') FROM orders_messy
  UNION ALL SELECT k, 3, 'priority', priority, trim(priority, """ + SPACES + """) FROM orders_messy
  UNION ALL SELECT k, 4, 'amount', coalesce(amount, '__NA__'), coalesce(replace(amount, '$', ''), '__NA__') FROM orders_messy)
"""


@query("diff_cells", oracle("orders_messy", _EDITED + "SELECT k, \"column\", old_value, new_value FROM edits WHERE old_value <> new_value"))
def diff_cells(spark, folder):
    return diff.changed_cells(view(spark, folder, "orders_messy"), _edited(spark, folder), ["k"])


@query("diff_cells_report", oracle("orders_messy", _EDITED + """
SELECT k, "column", old_value, new_value FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY k) AS r FROM edits
  WHERE old_value <> new_value) WHERE r <= 3 ORDER BY position, k LIMIT 5"""))
def diff_cells_report(spark, folder):
    return diff.sample_changes(view(spark, folder, "orders_messy"), _edited(spark, folder), ["k"])


@query("step_sentence", oracle("orders_messy orders_twice", """
SELECT 'drop_duplicates' AS action_type, 'Removed ' || (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_twice)))
  || ' of ' || count(*) || ' rows as duplicates' AS sentence FROM orders_twice
UNION ALL SELECT 'fill_null', 'Filled ' || (count(*) - count(price)) || ' missing cells of price using median '
  || CAST(CAST(round(median(price), 2) AS DECIMAL(18, 2)) AS VARCHAR) FROM orders_twice"""))
def step_sentence(spark, folder):
    before = view(spark, folder, "orders_twice")
    value = F.lit(fit_median(before, ["price"])["price"]).cast("decimal(18,2)")
    dropped = diff.impact_sentence(before, rows.drop_duplicates(before), "as duplicates")
    filled = diff.impact_sentence(before, fills.fill_median(before, "price"), "median", "price", value)
    return dropped.select(F.lit("drop_duplicates").alias("action_type"), "sentence").unionByName(
        filled.select(F.lit("fill_null").alias("action_type"), "sentence"))
