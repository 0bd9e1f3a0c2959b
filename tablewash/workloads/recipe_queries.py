"""Queries for whole recipes: given lists of steps, automatic cleaning, suggested steps, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.functions.text import BOOLEAN_MAP
from tablewash.operators.fits import fit_bounds, fit_median, fit_moments
from tablewash.plans.auto import auto_clean
from tablewash.plans.steps import run_steps
from tablewash.plans.suggest import clean_by_hints, clean_set_by_hints
from tablewash.session import scratch_dir
from tablewash.sources.tables import Relationship, TableSet
from tablewash.streaming.carried import ForwardFill
from tablewash.streaming.stream import apply_cell_steps, apply_fitted, drop_duplicates_within, keep_known, run_available
from tablewash.workloads.messy import CUSTOMERS, oracle, table, view
from tablewash.workloads.registry import query
from tablewash.workloads.steps_queries import DATES, IS_NUMBER, SPACES, STAMP, moment

NAME_SPARK = "CASE WHEN k % 13 <> 5 THEN 'Order_' || lpad(CAST(k AS STRING), 7, '0') END AS order_name"
NAME_DUCK = "'Order_' || lpad(CAST(k AS VARCHAR), 7, '0')"
TRIMMED = "trim({c}, " + SPACES + ")"
DATE = "strftime(try_strptime({c}, " + DATES + "), " + STAMP + ")"
MONEY = "TRY_CAST(replace(replace({c}, '$', ''), ',', '') AS DOUBLE)"
TRUE = "flag IN ('yes', 'Yes', '1', 'True')"


def _step(action: str, column: str | None = None, **more) -> dict:
    return {"action_type": action, "column": column, **more}


def _fill(column: str, method: str, value=None, **more) -> dict:
    return _step("fill_null", column, method=method, constant_value=value, **more)


def _money(column: str, **more) -> list[dict]:
    return [_step("replace_substring", column, old_value="$", new_value="", **more),
            _step("replace_substring", column, old_value=",", new_value="", **more),
            _step("convert_type", column, target_type="float", **more)]


def _kept(c: str, q: str = "q") -> str:
    return f"({c} IS NULL OR {c} BETWEEN {q}.q1 - 1.5 * ({q}.q3 - {q}.q1) AND {q}.q3 + 1.5 * ({q}.q3 - {q}.q1))"


def _quartiles(c: str, source: str) -> str:
    return f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}"


_FILLED_DAYS = """SELECT k, coalesce(last_value(day_text IGNORE NULLS) OVER (ORDER BY k),
  first_value(day_text IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS day_text"""


# --- recipes --------------------------------------------------------------------------------

@query("recipe_easy", oracle("orders_twice", f"""
, base AS (SELECT DISTINCT k, price, reading, status, day_text FROM orders_twice),
days AS ({_FILLED_DAYS} FROM base)
SELECT k, {NAME_DUCK} AS order_name, round(coalesce(price, (SELECT median(price) FROM base)), 4) AS price,
  round(coalesce(reading, (SELECT median(reading) FROM base)), 4) AS reading, coalesce(status, 'Unknown') AS status,
  {DATE.format(c='days.day_text')} AS day_text FROM base JOIN days USING (k)"""))
def recipe_easy(spark, folder):
    raw = view(spark, folder, "orders_twice").selectExpr("k", NAME_SPARK, "price", "reading", "status", "day_text")
    done = run_steps(raw, [
        _step("drop_duplicates"), _fill("price", "median"), _fill("reading", "median"), _fill("order_name", "sequential"),
        _fill("status", "constant", "Unknown"), _fill("day_text", "forward_fill"),
        _step("convert_type", "day_text", target_type="datetime"), _step("drop_duplicates"),
    ], order_by=["k"])
    return done.select("k", "order_name", F.round("price", 4).alias("price"), F.round("reading", 4).alias("reading"),
                       "status", moment("day_text"))


@query("recipe_medium", oracle("orders_messy", f"""
SELECT k, {MONEY.format(c='amount')} AS amount, {DATE.format(c='date_text')} AS date_text,
  {TRIMMED.format(c='priority')} AS priority, {TRUE} AS flag FROM orders_messy"""))
def recipe_medium(spark, folder):
    raw = view(spark, folder, "orders_messy").select("k", "amount", "date_text", "priority", "flag")
    done = run_steps(raw, [
        *_money("amount"), _step("convert_type", "date_text", target_type="datetime"),
        _step("strip_whitespace", "priority"), _step("map_values", "flag", mapping=BOOLEAN_MAP),
    ])
    return done.select("k", "amount", moment("date_text"), "priority", (F.col("flag") == "True").alias("flag"))


@query("recipe_hard", oracle("orders_messy", f"""
, base AS (SELECT k, spike, spike / (1 + k % 9) AS part, year_text FROM orders_messy),
a AS (SELECT base.* FROM base, ({_quartiles('spike', 'base')}) q WHERE {_kept('spike')}),
b AS (SELECT a.* FROM a, ({_quartiles('part', 'a')}) q WHERE {_kept('part')})
SELECT k, 'P' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_text, spike, part,
  {DATE.format(c="replace(year_text, '2098', '1998')")} AS year_text FROM b"""))
def recipe_hard(spark, folder):
    raw = view(spark, folder, "orders_messy").selectExpr("k", "id_text", "spike", "spike / (1 + k % 9) AS part", "year_text")
    done = run_steps(raw, [
        _step("standardize_format", "id_text"),
        _step("replace_substring", "year_text", old_value="2098", new_value="1998"),
        _step("convert_type", "year_text", target_type="datetime"),
        _step("remove_outliers", "spike"), _step("remove_outliers", "part"),
    ], order_by=["k"])
    return done.select("k", "id_text", "spike", "part", moment("year_text"))


@query("recipe_expert", oracle("orders_twice", f"""
, base AS (SELECT DISTINCT k, amount, reading, spike, status, date_text, id_text FROM orders_twice)
SELECT k, {MONEY.format(c='amount')} AS amount, round(coalesce(reading, (SELECT median(reading) FROM base)), 4) AS reading,
  spike, status, {DATE.format(c='date_text')} AS date_text, id_text
FROM base, ({_quartiles('spike', 'base')}) q WHERE {_kept('spike')}"""))
def recipe_expert(spark, folder):
    raw = view(spark, folder, "orders_twice").select("k", "amount", "reading", "spike", "status", "date_text", "id_text")
    done = run_steps(raw, [
        _step("drop_duplicates"), *_money("amount"), _fill("reading", "median"), _step("drop_duplicates"),
        _step("remove_outliers", "spike"), _step("convert_type", "date_text", target_type="datetime"),
    ], order_by=["k"])
    return done.select("k", "amount", F.round("reading", 4).alias("reading"), "spike", "status", moment("date_text"), "id_text")


def _two_tables(spark, folder) -> TableSet:
    return TableSet(
        {"orders": view(spark, folder, "orders_twice").select("k", "cust", "amount", "status", "day_text"),
         "customers": view(spark, folder, "customers_twice").select("k", "contact", "email", "segment")},
        (Relationship("orders", "cust", "customers", "k"),), primary="orders",
        order_by={"orders": ["k"], "customers": ["k"]})


TWO_TABLE_STEPS = [
    _step("drop_duplicates", table="customers"), _step("strip_whitespace", "contact", table="customers"),
    _fill("email", "constant", "unknown@example.com", table="customers"), _fill("segment", "mode", table="customers"),
    _step("drop_duplicates"), *_money("amount"), _fill("amount", "median"), _fill("status", "constant", "pending"),
    _step("validate_foreign_key", "cust", table="orders", foreign_key_column="cust", lookup_table="customers", lookup_key_column="k"),
    _step("convert_type", "day_text", target_type="datetime"), _step("drop_duplicates"),
]


@query("recipe_linked_orders", oracle("orders_twice customers_twice", f"""
, base AS (SELECT DISTINCT k, cust, {MONEY.format(c='amount')} AS amount, status, day_text FROM orders_twice)
SELECT k, cust, round(coalesce(amount, (SELECT median(amount) FROM base)), 4) AS amount, coalesce(status, 'pending') AS status,
  {DATE.format(c='day_text')} AS day_text FROM base WHERE cust IS NULL OR cust IN (SELECT k FROM customers_twice)"""))
def recipe_linked_orders(spark, folder):
    orders = run_steps(_two_tables(spark, folder), TWO_TABLE_STEPS)["orders"]
    return orders.select("k", "cust", F.round("amount", 4).alias("amount"), "status", moment("day_text"))


@query("recipe_linked_customers", oracle("customers_twice", f"""
, base AS (SELECT DISTINCT k, {TRIMMED.format(c='contact')} AS contact, email, segment FROM customers_twice)
SELECT k, contact, coalesce(email, 'unknown@example.com') AS email, coalesce(segment, (SELECT segment FROM base
  WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM base"""))
def recipe_linked_customers(spark, folder):
    return run_steps(_two_tables(spark, folder), TWO_TABLE_STEPS)["customers"]


_SALARY = {
    "spark": "CASE WHEN k % 15 <> 2 THEN '$' || format_number(balance, 2) END AS salary",
    "duck": "CASE WHEN k % 15 <> 2 THEN '$' || format('{:,.2f}', balance) END AS salary",
}


@query("recipe_contacts", oracle("customers_twice", f"""
, base AS (SELECT DISTINCT k, {TRIMMED.format(c='contact')} AS contact, email, segment, {MONEY.format(c='salary')} AS salary
  FROM (SELECT *, {_SALARY['duck']} FROM customers_twice))
SELECT k, contact, coalesce(email, 'unknown@example.com') AS email, coalesce(segment, 'Unknown') AS segment,
  round(coalesce(salary, (SELECT median(salary) FROM base)), 4) AS salary FROM base"""))
def recipe_contacts(spark, folder):
    raw = view(spark, folder, "customers_twice").selectExpr("k", "contact", "email", "segment", _SALARY["spark"])
    done = run_steps(raw, [
        _step("drop_duplicates"), _step("strip_whitespace", "contact"), _fill("email", "constant", "unknown@example.com"),
        _fill("segment", "constant", "Unknown"), *_money("salary"), _fill("salary", "median"), _step("drop_duplicates"),
    ], order_by=["k"])
    return done.withColumn("salary", F.round("salary", 4))


# --- automatic cleaning ---------------------------------------------------------------------

_AUTO = ("k", "price", "status", "priority", "number_text", "day_text", "date_text", "flag", "spike", "amount")


def _auto(spark, folder, level: str) -> DataFrame:
    raw = view(spark, folder, "orders_twice").selectExpr("k", NAME_SPARK, *_AUTO[1:])
    done = auto_clean(raw, ["k"], level)
    return done.select(*[
        moment(c) if c in ("day_text", "date_text") else F.round("price", 4).alias("price") if c == "price" else F.col(c)
        for c in done.columns
    ])


_AUTO_EASY = f"""
, base AS (SELECT DISTINCT {', '.join(_AUTO)} FROM orders_twice), days AS ({_FILLED_DAYS} FROM base),
easy AS (SELECT base.k, {NAME_DUCK} AS order_name, coalesce(price, (SELECT median(price) FROM base)) AS price,
  coalesce(status, 'Unknown') AS status, priority, number_text, {DATE.format(c='days.day_text')} AS day_text,
  {DATE.format(c='date_text')} AS date_text, flag, spike, coalesce(amount, 'Unknown') AS amount FROM base JOIN days USING (k)),
medium AS (SELECT * REPLACE ({TRIMMED.format(c='priority')} AS priority, {TRUE} AS flag,
  CASE WHEN {IS_NUMBER.format(c='number_text')} THEN TRY_CAST(number_text AS DOUBLE) END AS number_text) FROM easy),
h1 AS (SELECT medium.* FROM medium, ({_quartiles('k', 'medium')}) q WHERE {_kept('k')}),
h2 AS (SELECT h1.* FROM h1, ({_quartiles('price', 'h1')}) q WHERE {_kept('price')}),
h3 AS (SELECT h2.* FROM h2, ({_quartiles('number_text', 'h2')}) q WHERE {_kept('number_text')}),
hard AS (SELECT h3.* FROM h3, ({_quartiles('spike', 'h3')}) q WHERE {_kept('spike')})
"""


def _auto_query(level: str):
    @query(f"auto_clean_{level}", oracle("orders_twice", _AUTO_EASY + f"SELECT * REPLACE (round(price, 4) AS price) FROM {level}"))
    def run(spark, folder):
        return _auto(spark, folder, level)
    return run


for _level in ("easy", "medium", "hard"):
    _auto_query(_level)


# --- steps suggested from hints -------------------------------------------------------------

ORDER_HINTS = {
    "order_name": "Order identifier with a sequential pattern. Some missing values: fill with the sequential method.",
    "price": "Price of the order. Numeric. Missing values should use median.",
    "amount": "Amount in USD stored as string with '$' and ','. Remove both, then convert to float. Fill with median.",
    "status": "Status. Categorical string. Missing values: fill with constant 'pending'.",
    "priority": "Priority. Has whitespace around it.",
    "day_text": "Day of the order. Should be datetime. Missing values: use forward fill.",
    "spike": "Numeric with outliers that should be removed.",
    "id_text": "Order identifier, expected pattern 'P0000001', currently mixed. No type conversion needed.",
}


@query("suggested_clean", oracle("orders_twice", f"""
, base AS (SELECT DISTINCT k, price, {MONEY.format(c='amount')} AS amount, status, priority, {DATE.format(c='day_text')} AS day_text,
  spike FROM orders_twice),
days AS ({_FILLED_DAYS} FROM base),
filled AS (SELECT base.k, {NAME_DUCK} AS order_name, 'P' || lpad(CAST(k AS VARCHAR), 7, '0') AS id_text,
  round(coalesce(price, (SELECT median(price) FROM base)), 4) AS price,
  round(coalesce(amount, (SELECT median(amount) FROM base)), 4) AS amount, coalesce(status, 'pending') AS status,
  {TRIMMED.format(c='priority')} AS priority, days.day_text, spike FROM base JOIN days USING (k))
SELECT filled.* FROM filled, ({_quartiles('spike', 'filled')}) q WHERE {_kept('spike')}"""))
def suggested_clean(spark, folder):
    raw = view(spark, folder, "orders_twice").selectExpr(
        "k", NAME_SPARK, "id_text", "price", "amount", "status", "priority", "day_text", "spike")
    done, _ = clean_by_hints(raw, ORDER_HINTS, ["k"])
    return done.select(*[
        moment(c) if c == "day_text" else F.round(c, 4).alias(c) if c in ("price", "amount") else F.col(c) for c in done.columns])


_STEPS = """
SELECT * FROM (VALUES
  (0, 'drop_duplicates', NULL, NULL, 'Removed rows as duplicates'),
  (1, 'strip_whitespace', 'priority', NULL, 'Stripped whitespace around priority'),
  (2, 'standardize_format', 'id_text', NULL, 'Brought identifiers in id_text to one format'),
  (3, 'replace_substring', 'amount', NULL, 'Removed ''$'' from amount'),
  (4, 'replace_substring', 'amount', NULL, 'Removed '','' from amount'),
  (5, 'convert_type', 'amount', 'float', 'Converted amount to float'),
  (6, 'convert_type', 'day_text', 'datetime', 'Converted day_text to datetime'),
  (7, 'fill_null', 'order_name', 'sequential', 'Filled missing cells of order_name using sequential'),
  (8, 'fill_null', 'price', 'median', 'Filled missing cells of price using median'),
  (9, 'fill_null', 'amount', 'median', 'Filled missing cells of amount using median'),
  (10, 'fill_null', 'status', 'constant', 'Filled missing cells of status using constant ''pending'''),
  (11, 'fill_null', 'day_text', 'forward_fill', 'Filled missing cells of day_text using forward_fill'),
  (12, 'remove_outliers', 'spike', NULL, 'Removed rows with outliers in spike (iqr)'))
AS steps(position, action_type, "column", choice, sentence)"""


@query("suggested_steps", _STEPS)
def suggested_steps(spark, folder):
    raw = view(spark, folder, "orders_twice").selectExpr(
        "k", NAME_SPARK, "id_text", "price", "amount", "status", "priority", "day_text", "spike")
    _, steps = clean_by_hints(raw, ORDER_HINTS, ["k"])
    rows = [(i, s.action_type, s.column, s.method or s.target_type, s.sentence()) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "position int, action_type string, column string, choice string, sentence string")


@query("suggested_clean_linked", oracle("orders_twice customers_twice", f"""
, base AS (SELECT DISTINCT k, cust, {MONEY.format(c='amount')} AS amount, status FROM orders_twice
           WHERE cust IS NULL OR cust IN (SELECT k FROM customers_twice))
SELECT k, cust, round(coalesce(amount, (SELECT median(amount) FROM base)), 4) AS amount, coalesce(status, 'pending') AS status FROM base"""))
def suggested_clean_linked(spark, folder):
    tables = _two_tables(spark, folder)
    tables = tables.with_table("orders", tables["orders"].drop("day_text"))
    hints = {"orders": {c: ORDER_HINTS[c] for c in ("amount", "status")},
             "customers": {"contact": ORDER_HINTS["priority"], "email": "Missing values: fill with constant 'none'."}}
    # The customer of an order may be unknown; only a hint-driven fill would touch it.
    tables = tables.with_table("orders", tables["orders"].withColumn("cust", F.col("cust").cast("string")))
    tables = tables.with_table("customers", tables["customers"].withColumn("k", F.col("k").cast("string")))
    done, _ = clean_set_by_hints(tables, hints)
    return done["orders"].select("k", F.col("cust").cast("bigint").alias("cust"), F.round("amount", 4).alias("amount"), "status")


# --- streams --------------------------------------------------------------------------------

def _stream(spark, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _finished(stream: DataFrame) -> DataFrame:
    """Run the stream over what is there into a folder of its own and read that."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_cells", oracle("customers_messy", f"""
SELECT k, {TRIMMED.format(c='contact')} AS contact, coalesce(segment, 'Unknown') AS segment, replace(email, '@', ' at ') AS email
FROM customers_messy"""))
def stream_cells(spark, folder):
    columns = [c.strip() for c in CUSTOMERS.split(",\n")]
    stream = _stream(spark, folder, "customer").selectExpr(*columns[0:1], *columns[2:3], *columns[-2:])
    return _finished(apply_cell_steps(stream, [
        _step("strip_whitespace", "contact"), _fill("segment", "constant", "Unknown"),
        _step("replace_substring", "email", old_value="@", new_value=" at ")]))


_READING = "CASE WHEN event_id % 3 = 0 THEN value END AS reading"


@query("stream_fitted", f"""
WITH m AS (SELECT event_id, value, {_READING} FROM events),
f AS (SELECT median(reading) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM m)
SELECT event_id, round(coalesce(reading, med), 6) AS reading, round((value - lo) / (hi - lo), 6) AS value
FROM m, f WHERE {_kept('value', 'f')}""")
def stream_fitted(spark, folder):
    batch = table(spark, folder, "events").selectExpr("event_id", "value", _READING)
    stream = _stream(spark, folder, "events").selectExpr("event_id", "value", _READING)
    done = apply_fitted(stream, fill=fit_median(batch, ["reading"]), bounds=fit_bounds(batch, ["value"]),
                        scale=fit_moments(batch, ["value"]))
    return _finished(done).select("event_id", F.round("reading", 6).alias("reading"), F.round("value", 6).alias("value"))


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, folder):
    stream = _stream(spark, folder, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "explode(CASE WHEN event_id % 5 = 0 THEN array(1, 2, 3) ELSE array(1) END) AS copy")
    return _finished(drop_duplicates_within(stream.drop("copy"), "ts", "1 hour")).drop("ts")


@query("stream_known", """
SELECT event_id, who FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN user_id + 90000000 WHEN event_id % 9 = 0 THEN NULL
  ELSE user_id END AS who FROM events) WHERE who IS NULL OR who IN (SELECT c_custkey FROM customer)""")
def stream_known(spark, folder):
    stream = _stream(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN user_id + 90000000 WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS who")
    return _finished(keep_known(stream, "who", table(spark, folder, "customer"), "c_custkey"))


@query("stream_fill_forward", """
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN value END AS value FROM events)
SELECT event_id, user_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id),
   first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM m""")
def stream_fill_forward(spark, folder):
    """The events come in three stretches of time, each a run of the stream that goes on from the last."""
    events = table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "ts", "CASE WHEN event_id % 7 = 0 THEN value END AS value")
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    fill = ForwardFill(events.schema, "value", ["ts", "event_id"], ["user_id"], f"{base}/fill")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = (v or 0 for v in events.agg(F.min(micros), F.max(micros)).first())
    third = F.least(F.floor((micros - F.lit(first)) * 3 / F.lit(max(1, last - first))), F.lit(2))
    for part in range(3):
        mine = events.where(F.coalesce(third, F.lit(0)) == part)
        mine.write.mode("append").parquet(f"{base}/in")
        run_available(spark.readStream.schema(events.schema).parquet(f"{base}/in"), "", f"{base}/checkpoint", fill)
    return fill.filled(spark, rest=True).drop("ts")
