"""Messy views of the test tables, stated once for Spark and once for DuckDB.

The test tables are clean, so missing cells, stray characters, mixed spellings, outliers, copies
and dangling keys are put into all of their rows by rules on the primary key. No view leaves a
row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns both dialects spell alike.
_ORDERS = """
  o_orderkey AS k,
  CASE WHEN o_orderkey % 30 = 0 THEN o_custkey + 9000000
       WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 > 2 THEN o_totalprice END AS reading,
  CASE WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || '  '
       WHEN o_orderkey % 7 = 0 THEN o_orderpriority || chr(9) ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 13 <> 4 THEN '$' || {money} END AS amount,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN '12d'
       ELSE CAST(o_totalprice AS {text}) END AS number_text,
  CASE WHEN o_orderkey % 23 = 0 THEN 'junk' WHEN o_orderkey % 3 = 0 THEN {day_mon_year}
       WHEN o_orderkey % 3 = 1 THEN {slashes} ELSE {mon_day_year} END AS date_text,
  CASE WHEN o_orderkey % 20 = 0 THEN replace(CAST(o_orderdate AS {text}), '1998', '2098')
       ELSE CAST(o_orderdate AS {text}) END AS year_text,
  CASE WHEN o_orderkey % 8 <> 5 THEN {iso} END AS day_text,
  CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END
       WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END
       WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END
       ELSE CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END END AS flag,
  CASE o_orderkey % 3 WHEN 0 THEN 'P' || {padded} WHEN 1 THEN CAST(o_orderkey AS {text})
       ELSE {padded} END AS id_text,
  CASE WHEN o_orderkey % 40 = 7 THEN o_totalprice * 20 ELSE o_totalprice END AS spike
"""
_SPARK = {
    "text": "STRING", "money": "format_number(o_totalprice, 2)", "padded": "lpad(CAST(o_orderkey AS STRING), 7, '0')",
    "day_mon_year": "date_format(o_orderdate, 'dd-MMM-yyyy')", "slashes": "date_format(o_orderdate, 'yyyy/MM/dd')",
    "mon_day_year": "date_format(o_orderdate, 'MMM dd yyyy')", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')",
}
_DUCK = {
    "text": "VARCHAR", "money": "format('{:,.2f}', o_totalprice)", "padded": "lpad(CAST(o_orderkey AS VARCHAR), 7, '0')",
    "day_mon_year": "strftime(o_orderdate, '%d-%b-%Y')", "slashes": "strftime(o_orderdate, '%Y/%m/%d')",
    "mon_day_year": "strftime(o_orderdate, '%b %d %Y')", "iso": "strftime(o_orderdate, '%Y-%m-%d')",
}
_CUSTOMERS = """
  c_custkey AS k,
  CASE WHEN c_custkey % 13 <> 5 THEN c_name END AS name,
  CASE WHEN c_custkey % 6 = 0 THEN '  ' || c_name || '  ' ELSE c_name END AS contact,
  c_nationkey AS nation, c_acctbal AS balance,
  CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 12 <> 3 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email
"""
_LOG = """
  user_id AS run_id, event_id AS step,
  CASE event_type WHEN 'view' THEN 'fill_null' WHEN 'click' THEN 'drop_duplicates'
       WHEN 'purchase' THEN 'convert_type' WHEN 'signup' THEN 'strip_whitespace'
       ELSE 'remove_outliers' END AS action_type,
  CASE WHEN event_type <> 'click' THEN 'c' || CAST(event_id % 4 AS {text}) END AS "column",
  event_id % 12 <> 0 AS valid, 1 + event_id % 3 AS cost,
  100 + user_id % 5 * 60 AS initial_budget, value / 1000.0 AS quality
"""


def _both(template: str) -> tuple[str, str]:
    def put(values: dict[str, str]) -> str:
        out = template
        for key, value in values.items():
            out = out.replace("{" + key + "}", value)
        return out
    return put(_SPARK).replace('"', "`"), put(_DUCK)


_COPIES = "k % 50 = 0"

ORDERS, DUCK_ORDERS = _both(_ORDERS)
CUSTOMERS, DUCK_CUSTOMERS = _both(_CUSTOMERS)
LOG, DUCK_LOG = _both(_LOG)

DUCK = {
    "orders_messy": f"SELECT {DUCK_ORDERS} FROM orders",
    "customers_messy": f"SELECT {DUCK_CUSTOMERS} FROM customer",
    "run_log": f"SELECT {DUCK_LOG} FROM events",
    "orders_twice": f"SELECT m.* FROM orders_messy m JOIN (VALUES (1), (2)) t(copy) ON copy = 1 OR m.{_COPIES}",
    "customers_twice": f"SELECT m.* FROM customers_messy m JOIN (VALUES (1), (2)) t(copy) ON copy = 1 OR m.{_COPIES}",
    "customers_more": """
        SELECT CASE WHEN copy = 1 THEN k ELSE k + 10000000 END AS k,
               CASE WHEN copy = 1 THEN name END AS name, nation, balance
        FROM customers_messy m JOIN (VALUES (1), (2)) t(copy) ON copy = 1 OR m.k % 13 = 7""",
    "segments": """
        SELECT k, copy AS version,
               CASE WHEN copy = 1 THEN segment ELSE 'LATER' END AS segment
        FROM customers_messy m JOIN (VALUES (1), (2)) t(copy) ON copy = 1 OR m.k % 4 = 1""",
}
_NEEDS = {"orders_twice": "orders_messy", "customers_twice": "customers_messy",
          "customers_more": "customers_messy", "segments": "customers_messy"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A messy view as a DataFrame: narrow projections of one scan."""
    if name == "orders_messy":
        return _select(table(spark, folder, "orders"), ORDERS)
    if name == "customers_messy":
        return _select(table(spark, folder, "customer"), CUSTOMERS)
    if name == "run_log":
        return _select(table(spark, folder, "events"), LOG)
    base = view(spark, folder, _NEEDS[name])
    again = {"customers_more": "k % 13 = 7", "segments": "k % 4 = 1"}.get(name, _COPIES)
    rows = base.selectExpr("*", f"explode(CASE WHEN {again} THEN array(1, 2) ELSE array(1) END) AS copy")
    if name == "customers_more":
        return rows.selectExpr(
            "CASE WHEN copy = 1 THEN k ELSE k + 10000000 END AS k", "CASE WHEN copy = 1 THEN name END AS name",
            "nation", "balance")
    if name == "segments":
        return rows.selectExpr("k", "copy AS version", "CASE WHEN copy = 1 THEN segment ELSE 'LATER' END AS segment")
    return rows.drop("copy")


def _select(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {columns} FROM {{df}}", df=df)


def oracle(views: str, body: str) -> str:
    """``body`` with the named views (and those they need) in front of it."""
    names: list[str] = []
    for name in views.split():
        for n in (_NEEDS.get(name), name):
            if n and n not in names:
                names.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in names) + f"\n{body}"
