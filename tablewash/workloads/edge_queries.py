"""Queries on inputs that friendly tables do not have: long shared key texts, NULL keys, line breaks in
quotes, long integers, mixed spellings of dates, NaN beside NULL, booleans as text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewash.operators import cells, diff, fills, ordered, quality, rows
from tablewash.plans.steps import run_steps
from tablewash.session import scratch_dir
from tablewash.sources.tables import TableSet, read_table
from tablewash.workloads.messy import oracle, table, view
from tablewash.workloads.registry import query

_FORWARD = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {o}),
  first_value({c} IGNORE NULLS) OVER (ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("fill_forward_text_key", """
WITH m AS (SELECT doc_id, repeat('x', 300) || left(coalesce(text, ''), 40) AS t, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n FROM documents)
SELECT doc_id, """ + _FORWARD.format(c="n", o="t, doc_id") + " AS n FROM m")
def fill_forward_text_key(spark, folder):
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "repeat('x', 300) || left(coalesce(text, ''), 40) AS t", "CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n")
    return fills.fill_forward(docs, "n", ["t", "doc_id"]).drop("t")


@query("fill_forward_many_buckets", """
WITH m AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n FROM documents)
SELECT doc_id, """ + _FORWARD.format(c="n", o="t, doc_id") + " AS n FROM m")
def fill_forward_many_buckets(spark, folder):
    """More buckets than stand in a plan: their boundaries are a table."""
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "coalesce(text, '') AS t", "CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n")
    buckets = max(ordered.LITERAL_BUCKETS + 1, ordered.bucket_count(docs.count(), spark))
    return fills.fill_forward(docs, "n", ["t", "doc_id"], buckets=buckets).drop("t")


@query("fill_forward_null_key", """
WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey <> (SELECT min(o_orderkey) FROM orders) THEN o_orderkey END AS o,
  CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) OR o_orderkey % 50 = 0 THEN o_totalprice END AS p FROM orders)
SELECT k, last_value(p IGNORE NULLS) OVER (ORDER BY o NULLS FIRST) AS p FROM m""")
def fill_forward_null_key(spark, folder):
    orders = table(spark, folder, "orders")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    rows_ = orders.selectExpr(
        "o_orderkey AS k", f"CASE WHEN o_orderkey <> {least} THEN o_orderkey END AS o",
        f"CASE WHEN o_orderkey = {least} OR o_orderkey % 50 = 0 THEN o_totalprice END AS p")
    return fills.fill_forward(rows_, "p", ["o"]).drop("o")


@query("src_quoted_text", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS text_md5, 1234567890123456000 + doc_id AS big FROM documents WHERE text <> ''""")
def src_quoted_text(spark, folder):
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").where("text <> ''").selectExpr("doc_id", "text", "1234567890123456000 + doc_id AS big")
    docs.write.csv(path, header=True, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_table(spark, path, infer=True).select("doc_id", F.md5("text").alias("text_md5"), "big")


@query("src_quoted_many_tasks", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS text_md5, 1234567890123456000 + doc_id AS big FROM documents WHERE text <> ''""")
def src_quoted_many_tasks(spark, folder):
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").where("text <> ''").selectExpr("doc_id", "text", "1234567890123456000 + doc_id AS big")
    docs.write.csv(path, header=True, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_table(spark, path, infer=True, many_tasks=True).select("doc_id", F.md5("text").alias("text_md5"), "big")


_DIFF = """
WITH lowest AS (SELECT min(o_orderkey) AS k FROM orders),
old AS (SELECT CASE WHEN o_orderkey <> (SELECT k FROM lowest) THEN o_orderkey END AS k, o_orderstatus AS status,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust FROM orders),
new AS (SELECT k, CASE WHEN k % 300 = 0 THEN 'X' ELSE status END AS status, CASE WHEN k IS NULL OR k % 200 = 0 THEN 7 ELSE cust END AS cust
  FROM old WHERE k IS NULL OR k % 500 <> 0
  UNION ALL SELECT -k, status, cust FROM old WHERE k % 700 = 0)"""


@query("diff_rows", _DIFF + """,
told AS (
  SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change,
    unnest(['status', 'cust']) AS "column",
    unnest([CASE WHEN o.h THEN coalesce(o.status, '__NA__') END, CASE WHEN o.h THEN coalesce(CAST(o.cust AS VARCHAR), '__NA__') END]) AS old_value,
    unnest([CASE WHEN n.h THEN coalesce(n.status, '__NA__') END, CASE WHEN n.h THEN coalesce(CAST(n.cust AS VARCHAR), '__NA__') END]) AS new_value
  FROM (SELECT *, true AS h FROM old) o FULL OUTER JOIN (SELECT *, true AS h FROM new) n ON o.k IS NOT DISTINCT FROM n.k)
SELECT * FROM told WHERE old_value IS DISTINCT FROM new_value""")
def diff_rows(spark, folder):
    orders = table(spark, folder, "orders")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    old = orders.selectExpr(
        f"CASE WHEN o_orderkey <> {least} THEN o_orderkey END AS k", "o_orderstatus AS status",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust")
    kept = old.where("k IS NULL OR k % 500 <> 0").selectExpr(
        "k", "CASE WHEN k % 300 = 0 THEN 'X' ELSE status END AS status", "CASE WHEN k IS NULL OR k % 200 = 0 THEN 7 ELSE cust END AS cust")
    return diff.diff_rows(old, kept.union(old.where("k % 700 = 0").selectExpr("-k AS k", "status", "cust")), ["k"])


@query("cell_to_int_large", """
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 9007199254740993 + o_orderkey WHEN 1 THEN 1234567890123456789 ELSE o_orderkey END AS n FROM orders""")
def cell_to_int_large(spark, folder):
    text = table(spark, folder, "orders").selectExpr("o_orderkey AS k", """
        CASE o_orderkey % 3 WHEN 0 THEN CAST(9007199254740993 + o_orderkey AS STRING) WHEN 1 THEN ' 1234567890123456789'
        ELSE CAST(o_orderkey AS STRING) || '.0' END AS n""")
    return cells.to_int(text, "n")


@query("cell_to_datetime_mixed", """
SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + CASE WHEN o_orderkey % 13 IN (8, 9) THEN INTERVAL 10 HOUR + INTERVAL 30 MINUTE
  WHEN o_orderkey % 13 = 10 THEN INTERVAL 10 HOUR WHEN o_orderkey % 13 = 11 THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END AS d FROM orders""")
def cell_to_datetime_mixed(spark, folder):
    shapes = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd", "yyyy.MM.dd", "MM-dd-yyyy", "M/d/yyyy",
              "MM/dd/yyyy 10:30", "MMM d, yyyy 10:30:00", "yyyy-MM-dd'T'10:00:00'Z'", "yyyy-MM-dd 10:00:00'+02:00'", "MMM d yyyy"]
    orders = table(spark, folder, "orders")
    spelled = F.lit(None)
    for i, shape in enumerate(shapes):
        spelled = F.when(F.col("o_orderkey") % len(shapes) == i, F.date_format("o_orderdate", shape)).otherwise(spelled)
    return cells.to_timestamp_mixed(orders.select(F.col("o_orderkey").alias("k"), spelled.alias("d")), "d").withColumn(
        "d", F.col("d").cast("timestamp_ntz"))


@query("cell_to_string_large", """
SELECT o_orderkey AS k, CAST(12345678 + o_orderkey AS VARCHAR) || '.5' AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS b FROM orders""")
def cell_to_string_large(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS k", "CAST(12345678 + o_orderkey AS DOUBLE) + 0.5D AS s", "o_orderkey % 2 = 0 AS b")
    return cells.to_string(cells.to_string(df, "s"), "b")


@query("dedup_nan", "SELECT DISTINCT o_custkey % 100 AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS v FROM orders")
def dedup_nan(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_custkey % 100 AS c", """
        CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 7 AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) END AS v""")
    return rows.drop_duplicates(df).withColumn("v", F.col("v").cast("bigint"))


@query("qual_boolean_text", "SELECT 'b' AS \"column\", 'text' AS kind, count(*) AS matches FROM orders")
def qual_boolean_text(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey % 3 = 0 AS b")
    told = df.selectExpr("CASE WHEN b THEN 'True' ELSE 'False' END AS b")
    return quality.column_matches(told, df)


@query("dedup_linked_row_id", oracle("orders_messy", "SELECT k AS rid, status FROM orders_messy"))
def dedup_linked_row_id(spark, folder):
    once = view(spark, folder, "orders_messy").select(F.col("k"), "status")
    twice = once.selectExpr("k", "status", "explode(array(k, k + 100000000)) AS rid")
    done = run_steps(TableSet({"orders": twice}, primary="orders"), [{"action_type": "drop_duplicates"}], row_id="rid")
    return done["orders"].select("rid", "status")
