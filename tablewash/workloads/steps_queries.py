"""Queries for single cleaning steps: sources, cells, fills, links, rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.functions.text import BOOLEAN_MAP
from tablewash.operators import cells, fills, relate, rows
from tablewash.session import scratch_dir
from tablewash.sources.tables import Relationship, TableSet, append_rows, preview, preview_text, read_table, stack_tables
from tablewash.workloads.messy import oracle, table, view
from tablewash.workloads.registry import query

# DuckDB spellings used in several oracles.
IS_NUMBER = r"regexp_full_match({c}, '\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*')"
DATES = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d', '%d-%b-%Y', '%b %d %Y', '%m/%d/%Y', '%d/%m/%Y']"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def moment(c: str):
    """A timestamp as text, so that no session time zone enters the comparison."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return view(spark, folder, "orders_messy").select("k", *columns)


# --- sources and table assembly -------------------------------------------------------------

@query("src_null_tokens", oracle("orders_messy", f"""
SELECT k, price, CASE WHEN number_text <> 'n/a' THEN number_text END AS number_text, flag, amount
FROM orders_messy"""))
def src_null_tokens(spark, folder):
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    _orders(spark, folder, "price", "number_text", "flag", "amount").write.csv(path, header=True, nullValue="NA", escape='"')
    return read_table(spark, path, schema="k bigint, price double, number_text string, flag string, amount string")


@query("src_inferred_types", oracle("orders_messy", """
SELECT k, price, cust, CASE WHEN number_text <> 'n/a' THEN number_text END AS number_text FROM orders_messy"""))
def src_inferred_types(spark, folder):
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    _orders(spark, folder, "price", "cust", "number_text").write.csv(path, header=True, nullValue="N/A")
    return read_table(spark, path, infer=True)


@query("set_union_all", oracle("orders_messy", """
SELECT status, count(*) AS n, count(DISTINCT k) AS orders FROM
  (SELECT k, status FROM orders_messy UNION ALL SELECT o_orderkey, o_orderstatus FROM orders) GROUP BY status"""))
def set_union_all(spark, folder):
    clean = table(spark, folder, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS status")
    both = append_rows(_orders(spark, folder, "status"), clean)
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("orders"))


@query("set_labelled_union", """
SELECT 'customer' AS _table, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'NULL' AS o_orderkey, 'NULL' AS o_orderstatus
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10)
UNION ALL SELECT 'orders', 'NULL', 'NULL', CAST(o_orderkey AS VARCHAR), o_orderstatus
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)""")
def set_labelled_union(spark, folder):
    tables = {
        "customer": table(spark, folder, "customer").select("c_custkey", "c_name"),
        "orders": table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"),
    }
    return stack_tables(tables, {"customer": ["c_custkey"], "orders": ["o_orderkey"]})


@query("topk_preview", oracle("orders_messy", "SELECT k, cust, price, status FROM orders_messy ORDER BY k LIMIT 5"))
def topk_preview(spark, folder):
    return preview(_orders(spark, folder, "cust", "price", "status"), ["k"])


@query("topk_preview_text", oracle("orders_messy", """
SELECT CAST(k AS VARCHAR) AS k, coalesce(CAST(price AS VARCHAR), 'NULL') AS price, coalesce(status, 'NULL') AS status
FROM orders_messy ORDER BY orders_messy.k LIMIT 50"""))
def topk_preview_text(spark, folder):
    return preview_text(_orders(spark, folder, "price", "status"), ["k"], 50)


# --- cells ----------------------------------------------------------------------------------

@query("cell_strip", oracle("orders_messy", f"SELECT k, trim(priority, {SPACES}) AS priority FROM orders_messy"))
def cell_strip(spark, folder):
    return cells.strip_whitespace(_orders(spark, folder, "priority"), "priority")


@query("cell_strip_documents", f"""
SELECT doc_id, trim(text, {SPACES} || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760)
  || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200)
  || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) AS text
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(160) || text || chr(10) WHEN 1 THEN text || chr(12288) ELSE text END AS text
      FROM documents)""")
def cell_strip_documents(spark, folder):
    padded = table(spark, folder, "documents").selectExpr(
        "doc_id", "CASE doc_id % 3 WHEN 0 THEN '\\u00a0' || text || chr(10) WHEN 1 THEN text || '\\u3000' ELSE text END AS text")
    return cells.strip_whitespace(padded, "text")


@query("cell_replace", oracle("orders_messy", "SELECT k, replace(amount, ',', '') AS amount FROM orders_messy"))
def cell_replace(spark, folder):
    return cells.replace_substring(_orders(spark, folder, "amount"), "amount", ",", "")


@query("cell_year_typo", oracle("orders_messy", f"""
SELECT k, strftime(try_strptime(replace(year_text, '2098', '1998'), {DATES}), {STAMP}) AS year_text FROM orders_messy"""))
def cell_year_typo(spark, folder):
    df = cells.replace_substring(_orders(spark, folder, "year_text"), "year_text", "2098", "1998")
    return cells.to_timestamp_mixed(df, "year_text").select("k", moment("year_text"))


@query("cell_currency", oracle("orders_messy", """
SELECT k, TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS amount FROM orders_messy"""))
def cell_currency(spark, folder):
    return cells.clean_currency(_orders(spark, folder, "amount"), "amount")


@query("cell_map_values", oracle("orders_messy", """
SELECT k, CASE status WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE status END AS status FROM orders_messy"""))
def cell_map_values(spark, folder):
    return cells.map_values(_orders(spark, folder, "status"), "status", {"F": "finished", "O": "open"})


@query("cell_to_boolean", oracle("orders_messy", """
SELECT k, CASE WHEN flag IN ('yes', 'Yes', 'YES', 'true', 'True', 'TRUE', '1') THEN true
               WHEN flag IN ('no', 'No', 'NO', 'false', 'False', 'FALSE', '0') THEN false END AS flag
FROM orders_messy"""))
def cell_to_boolean(spark, folder):
    return cells.to_boolean(_orders(spark, folder, "flag"), "flag")


@query("cell_to_float", oracle("orders_messy", f"""
SELECT k, CASE WHEN {IS_NUMBER.format(c='number_text')} THEN TRY_CAST(number_text AS DOUBLE) END AS number_text
FROM orders_messy"""))
def cell_to_float(spark, folder):
    return cells.to_float(_orders(spark, folder, "number_text"), "number_text")


@query("cell_to_int", oracle("orders_messy", r"""
SELECT k, CASE WHEN regexp_full_match(id_text, '[0-9]+') THEN CAST(id_text AS BIGINT) END AS id_text,
       CASE WHEN spike = floor(spike) THEN CAST(spike AS BIGINT) END AS spike
FROM orders_messy"""))
def cell_to_int(spark, folder):
    df = cells.to_int(_orders(spark, folder, "id_text", "spike"), "id_text")
    return cells.to_int(df, "spike", on_fraction="null")


@query("cell_to_datetime", oracle("orders_messy", f"""
SELECT k, strftime(try_strptime(date_text, {DATES}), {STAMP}) AS date_text FROM orders_messy"""))
def cell_to_datetime(spark, folder):
    return cells.to_timestamp_mixed(_orders(spark, folder, "date_text"), "date_text").select("k", moment("date_text"))


@query("cell_to_string", oracle("orders_messy", """
SELECT CAST(k AS VARCHAR) AS k, CAST(price AS VARCHAR) AS price FROM orders_messy"""))
def cell_to_string(spark, folder):
    return cells.to_string(cells.to_string(_orders(spark, folder, "price"), "price"), "k")


@query("cell_standardize_ids", oracle("orders_messy", """
SELECT k, 'P' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_text FROM orders_messy"""))
def cell_standardize_ids(spark, folder):
    return cells.standardize_ids(_orders(spark, folder, "id_text"), "id_text", ["k"])


@query("cell_standardize_fit", """
WITH m AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'S-' || CAST(s_suppkey AS VARCHAR)
             WHEN 1 THEN s_name WHEN 2 THEN 'T' || CAST(s_suppkey AS VARCHAR) || 'x' ELSE s_name END AS code FROM supplier),
parts AS (SELECT *, regexp_extract(code, '([0-9]+)$', 1) AS digits FROM m),
fit AS (SELECT left(code, length(code) - length(digits)) AS prefix, count(*) AS n, min(length(digits)) AS w0,
               max(length(digits)) AS w1 FROM parts WHERE digits <> '' AND length(code) > length(digits)
        GROUP BY 1 ORDER BY n DESC, min(k) LIMIT 1)
SELECT k, CASE WHEN digits = '' THEN code WHEN w0 = w1 AND length(CAST(CAST(digits AS BIGINT) AS VARCHAR)) < w0
            THEN prefix || lpad(CAST(CAST(digits AS BIGINT) AS VARCHAR), CAST(w0 AS INTEGER), '0')
            ELSE prefix || CAST(CAST(digits AS BIGINT) AS VARCHAR) END AS code
FROM parts, fit""")
def cell_standardize_fit(spark, folder):
    codes = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS k", "CASE s_suppkey % 4 WHEN 0 THEN 'S-' || CAST(s_suppkey AS STRING) WHEN 1 THEN s_name "
        "WHEN 2 THEN 'T' || CAST(s_suppkey AS STRING) || 'x' ELSE s_name END AS code")
    return cells.standardize_ids(codes, "code", ["k"])


@query("norm_minmax", oracle("orders_messy", """
SELECT k, round((price - (SELECT min(price) FROM orders_messy)) /
  (SELECT max(price) - min(price) FROM orders_messy), 6) AS price FROM orders_messy"""))
def norm_minmax(spark, folder):
    return cells.normalize(_orders(spark, folder, "price"), "price").select("k", F.round("price", 6).alias("price"))


@query("norm_zscore", oracle("orders_messy", """
SELECT k, round((price - (SELECT avg(price) FROM orders_messy)) /
  (SELECT stddev_samp(price) FROM orders_messy), 6) AS price FROM orders_messy"""))
def norm_zscore(spark, folder):
    scaled = cells.normalize(_orders(spark, folder, "price"), "price", "zscore")
    return scaled.select("k", F.round("price", 6).alias("price"))


# --- fills ----------------------------------------------------------------------------------

@query("fill_mean", oracle("orders_messy", """
SELECT k, round(coalesce(price, (SELECT avg(price) FROM orders_messy)), 4) AS price FROM orders_messy"""))
def fill_mean(spark, folder):
    return fills.fill_mean(_orders(spark, folder, "price"), "price").select("k", F.round("price", 4).alias("price"))


@query("fill_median", oracle("orders_messy", """
SELECT k, round(coalesce(price, (SELECT median(price) FROM orders_messy)), 4) AS price,
       round(coalesce(reading, (SELECT median(reading) FROM orders_messy)), 4) AS reading FROM orders_messy"""))
def fill_median(spark, folder):
    done = fills.fill_median(_orders(spark, folder, "price", "reading"), "price", "reading")
    return done.select("k", F.round("price", 4).alias("price"), F.round("reading", 4).alias("reading"))


@query("fill_mode", oracle("orders_messy", """
SELECT k, coalesce(status, (SELECT status FROM orders_messy WHERE status IS NOT NULL
  GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM orders_messy"""))
def fill_mode(spark, folder):
    return fills.fill_mode(_orders(spark, folder, "status"), "status")


@query("fill_constant", oracle("orders_messy", """
SELECT k, coalesce(status, 'Unknown') AS status, coalesce(price, 0) AS price FROM orders_messy"""))
def fill_constant(spark, folder):
    df = fills.fill_constant(_orders(spark, folder, "status", "price"), "status", "Unknown")
    return fills.fill_constant(df, "price", 0)


@query("fill_forward", oracle("orders_messy", """
SELECT k, status, coalesce(last_value(reading IGNORE NULLS) OVER (ORDER BY k),
   first_value(reading IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS reading
FROM orders_messy"""))
def fill_forward(spark, folder):
    return fills.fill_forward(_orders(spark, folder, "status", "reading"), "reading", ["k"])


@query("fill_backward", oracle("orders_messy", """
SELECT k, status, coalesce(first_value(reading IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   last_value(reading IGNORE NULLS) OVER (ORDER BY k)) AS reading FROM orders_messy"""))
def fill_backward(spark, folder):
    return fills.fill_backward(_orders(spark, folder, "status", "reading"), "reading", ["k"])


@query("fill_forward_grouped", """
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events)
SELECT event_id, user_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id),
   first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM m""")
def fill_forward_grouped(spark, folder):
    rows_ = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "ts", "CASE WHEN event_id % 3 = 0 THEN value END AS value")
    return fills.fill_forward(rows_, "value", ["ts", "event_id"], partition_by=["user_id"]).drop("ts")


@query("fill_sequential", """
SELECT c_custkey AS k, c_name AS name FROM customer""")
def fill_sequential(spark, folder):
    return fills.fill_sequential(view(spark, folder, "customers_messy").select("k", "name"), "name", ["k"])


@query("fill_sequential_beyond", oracle("customers_more", r""", nums AS (SELECT DISTINCT CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS n FROM customers_more WHERE name IS NOT NULL),
asked AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM customers_more WHERE name IS NULL),
span AS (SELECT min(n) AS lo, max(n) AS hi, (SELECT count(*) FROM asked) AS extra FROM nums),
free AS (SELECT g AS n, row_number() OVER (ORDER BY g) AS r
         FROM (SELECT unnest(generate_series(lo, hi + extra)) AS g FROM span) WHERE g NOT IN (SELECT n FROM nums))
SELECT m.k, coalesce(m.name, 'Customer#' || lpad(CAST(f.n AS VARCHAR), 9, '0')) AS name
FROM customers_more m LEFT JOIN asked a ON a.k = m.k LEFT JOIN free f ON f.r = a.r"""))
def fill_sequential_beyond(spark, folder):
    return fills.fill_sequential(view(spark, folder, "customers_more").select("k", "name"), "name", ["k"])


@query("fill_sequential_fallback", oracle("orders_messy", "SELECT k, coalesce(status, 'Unknown') AS status FROM orders_messy"))
def fill_sequential_fallback(spark, folder):
    return fills.fill_sequential(_orders(spark, folder, "status"), "status", ["k"])


# --- links ----------------------------------------------------------------------------------

@query("join_lookup_fill", oracle("orders_messy segments", """
, firsts AS (SELECT k, arg_min(coalesce(segment, '~'), version) AS segment FROM segments GROUP BY k),
asks AS (SELECT k, cust, CASE WHEN k % 3 = 1 THEN 'KNOWN' END AS segment FROM orders_messy)
SELECT a.k, a.cust, coalesce(a.segment, nullif(f.segment, '~')) AS segment FROM asks a LEFT JOIN firsts f ON a.cust = f.k"""))
def join_lookup_fill(spark, folder):
    asks = _orders(spark, folder, "cust").withColumn("segment", F.expr("CASE WHEN k % 3 = 1 THEN 'KNOWN' END"))
    return relate.lookup_fill(asks, "segment", "cust", view(spark, folder, "segments"), "k", "segment", ["version"])


@query("join_enforce_fk", oracle("orders_messy", """
SELECT k, cust, status FROM orders_messy WHERE cust IS NULL OR cust IN (SELECT c_custkey FROM customer)"""))
def join_enforce_fk(spark, folder):
    return relate.enforce_fk(_orders(spark, folder, "cust", "status"), "cust", table(spark, folder, "customer"), "c_custkey")


@query("join_fk_orphans", oracle("orders_messy", """
SELECT k, cust FROM orders_messy WHERE cust IS NOT NULL AND cust NOT IN (SELECT c_custkey FROM customer)"""))
def join_fk_orphans(spark, folder):
    return relate.fk_orphans(_orders(spark, folder, "cust"), "cust", table(spark, folder, "customer"), "c_custkey")


def linked_tables(spark, folder) -> TableSet:
    return TableSet(
        {"orders": view(spark, folder, "orders_twice"), "customers": view(spark, folder, "customers_twice"),
         "lineitem": table(spark, folder, "lineitem")},
        (Relationship("orders", "cust", "customers", "k"), Relationship("lineitem", "l_orderkey", "orders", "k"),
         Relationship("lineitem", "l_orderkey", "nowhere", "k")),
        primary="orders", order_by={"orders": ["k"], "customers": ["k"], "lineitem": ["l_orderkey", "l_linenumber"]},
    )


@query("agg_fk_integrity", oracle("orders_twice customers_twice", """
SELECT 'orders.cust' AS relationship, count(cust) AS child_rows,
  CAST(sum(CASE WHEN cust IN (SELECT k FROM customers_twice) THEN 1 ELSE 0 END) AS BIGINT) AS matched_rows,
  round(sum(CASE WHEN cust IN (SELECT k FROM customers_twice) THEN 1.0 ELSE 0 END) / count(cust), 6) AS integrity FROM orders_twice
UNION ALL SELECT 'lineitem.l_orderkey', count(*),
  CAST(sum(CASE WHEN l_orderkey IN (SELECT k FROM orders_twice) THEN 1 ELSE 0 END) AS BIGINT),
  round(sum(CASE WHEN l_orderkey IN (SELECT k FROM orders_twice) THEN 1.0 ELSE 0 END) / count(*), 6) FROM lineitem
UNION ALL SELECT 'lineitem.l_orderkey', 0, 0, 0.0"""))
def agg_fk_integrity(spark, folder):
    return relate.fk_integrity(linked_tables(spark, folder)).withColumn("integrity", F.round("integrity", 6))


# --- rows -----------------------------------------------------------------------------------

@query("dedup_rows", oracle("orders_twice", "SELECT DISTINCT * FROM orders_twice"))
def dedup_rows(spark, folder):
    return rows.drop_duplicates(view(spark, folder, "orders_twice"))


@query("dedup_keep_first", """
SELECT status, priority, min(k) AS k FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, o_orderkey AS k FROM orders)
GROUP BY status, priority""")
def dedup_keep_first(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderstatus AS status", "o_orderpriority AS priority", "o_orderkey AS k")
    return rows.drop_duplicates(df, row_id="k")


@query("dedup_documents", "SELECT text, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source")
def dedup_documents(spark, folder):
    return rows.drop_duplicates(table(spark, folder, "documents").drop("n_chars"), row_id="doc_id")


@query("outlier_iqr", oracle("orders_messy", """
, q AS (SELECT quantile_cont(spike, 0.25) AS q1, quantile_cont(spike, 0.75) AS q3 FROM orders_messy)
SELECT k, spike FROM orders_messy, q WHERE spike IS NULL OR spike BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""))
def outlier_iqr(spark, folder):
    return rows.remove_outliers(_orders(spark, folder, "spike"), "spike")


@query("outlier_zscore", oracle("orders_messy", """
, s AS (SELECT avg(spike) AS m, stddev_samp(spike) AS d FROM orders_messy)
SELECT k, spike, price FROM orders_messy, s WHERE spike IS NULL OR abs(spike - m) / d <= 3.0"""))
def outlier_zscore(spark, folder):
    return rows.remove_outliers(_orders(spark, folder, "spike", "price"), "spike", "zscore")


@query("outlier_iqr_multi", oracle("orders_messy", """
, q AS (SELECT quantile_cont(spike, 0.25) AS q1, quantile_cont(spike, 0.75) AS q3 FROM orders_messy),
a AS (SELECT k, price, spike, spike / (1 + k % 9) AS part FROM orders_messy, q
      WHERE spike IS NULL OR spike BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
r AS (SELECT quantile_cont(part, 0.25) AS q1, quantile_cont(part, 0.75) AS q3 FROM a)
SELECT k, price, spike FROM a, r WHERE part IS NULL OR part BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""))
def outlier_iqr_multi(spark, folder):
    df = _orders(spark, folder, "price", "spike").withColumn("part", F.expr("spike / (1 + k % 9)"))
    return rows.remove_outliers_all(df, ["spike", "part"]).drop("part")


@query("outlier_lineitem", """
WITH q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
           FROM (SELECT l_extendedprice * (1 - l_discount) * CASE WHEN l_partkey % 97 = 3 THEN 30 ELSE 1 END AS x FROM lineitem))
SELECT l_orderkey, l_linenumber, x FROM (SELECT l_orderkey, l_linenumber,
  l_extendedprice * (1 - l_discount) * CASE WHEN l_partkey % 97 = 3 THEN 30 ELSE 1 END AS x FROM lineitem), q
WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def outlier_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "l_extendedprice * (1 - l_discount) * CASE WHEN l_partkey % 97 = 3 THEN 30 ELSE 1 END AS x")
    return rows.remove_outliers(df, "x")


__all__ = ["BOOLEAN_MAP", "linked_tables", "moment"]
