"""Queries for quality scores, validation rules and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewash.operators import quality, runlog, validate
from tablewash.sources.tables import Relationship, TableSet
from tablewash.workloads.messy import oracle, table, view
from tablewash.workloads.registry import query

EPS = "0.0001"


def clamp_sql(e: str) -> str:
    return f"round(greatest({EPS}, least(1 - {EPS}, {e})), 6)"


# --- quality --------------------------------------------------------------------------------
# A half-cleaned table against the original. Half of the numbers are off by less than the
# tolerance, so that different values have to match as well as equal ones.

_CURRENT = """k, price + CASE WHEN k % 2 = 0 THEN 0.0000004 ELSE 0 END AS price, status, priority, spike, cust, flag"""
_TRUTH = """o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority,
  o_totalprice AS spike, o_custkey AS cust, o_orderstatus = 'F' AS flag"""
_NUMERIC = ("k", "price", "spike", "cust")
_TEXT = ("status", "priority", "flag")


def scored(spark, folder):
    current = view(spark, folder, "orders_twice").selectExpr(*[c.strip() for c in _CURRENT.split(", ")])
    truth = table(spark, folder, "orders").selectExpr(*[c.strip() for c in _TRUTH.split(",")])
    return current, truth


_SIDES = f"""
, cur AS (SELECT {_CURRENT} FROM orders_twice), ref AS (SELECT {_TRUTH} FROM orders),
size AS (SELECT count(*) AS n, (SELECT count(*) FROM ref) AS m, least(count(*), (SELECT count(*) FROM ref)) AS lo,
                greatest(count(*), (SELECT count(*) FROM ref)) AS hi FROM cur)"""


def number_match_sql(c: str, cur: str = "cur", ref: str = "ref", size: str = "size") -> str:
    return f"""SELECT '{c}' AS "column", 'number' AS kind, least((SELECT lo FROM {size}), (SELECT count(*)
      FROM (SELECT {c} AS a, row_number() OVER (ORDER BY {c}) AS r FROM {cur} WHERE {c} IS NOT NULL) x
      JOIN (SELECT {c} AS b, row_number() OVER (ORDER BY {c}) AS r FROM {ref} WHERE {c} IS NOT NULL) y USING (r)
      WHERE r <= (SELECT lo FROM {size}) AND abs(a - b) < 1e-6)
      + least((SELECT count(*) - count({c}) FROM {cur}), (SELECT count(*) - count({c}) FROM {ref}))) AS matches"""


def text_match_sql(c: str, cur: str = "cur", ref: str = "ref", size: str = "size", cast: str = "CAST({c} AS VARCHAR)") -> str:
    cell = f"coalesce({cast.format(c=c)}, '__NULL__')"
    return f"""SELECT '{c}' AS "column", 'text' AS kind, (SELECT count(*)
      FROM (SELECT {cell} AS a, row_number() OVER (ORDER BY {cell}) AS r FROM {cur}) x
      JOIN (SELECT {cell} AS b, row_number() OVER (ORDER BY {cell}) AS r FROM {ref}) y USING (r)
      WHERE r <= (SELECT lo FROM {size}) AND a = b) AS matches"""


# A boolean's text is True or False.
_WRITTEN = "CASE WHEN typeof({c}) = 'BOOLEAN' THEN CASE CAST({c} AS VARCHAR) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END ELSE CAST({c} AS VARCHAR) END"


_MATCHES = ",\nmatches AS (" + "\nUNION ALL ".join(
    [number_match_sql(c) for c in _NUMERIC] + [text_match_sql(c, cast=_WRITTEN) for c in _TEXT]) + ")\n"
_COLUMNS = (*_NUMERIC, *_TEXT)
_NULL_SHARE = "(SELECT (" + " + ".join(f"count(*) - count({c})" for c in _COLUMNS) + f") / (count(*) * {len(_COLUMNS)}) FROM cur)"
_COPY_SHARE = "(SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cur))) / count(*) FROM cur)"
_CORRECT = f"(SELECT sum(matches) FROM matches) / (lo * {len(_COLUMNS)}) * (lo / hi)"
_COMPLETE = f"0.6 * pow(greatest(0, 1 - {_NULL_SHARE} / 0.2), 2) + 0.4 * pow(greatest(0, 1 - {_COPY_SHARE} / 0.2), 2)"
# flag is text on one side and boolean on the other; all other types agree.
_SCHEMA = f"{len(_COLUMNS) - 1}.0 / {len(_COLUMNS)}"


@query("qual_numeric_match", oracle("orders_messy orders_twice", _SIDES + _MATCHES + "SELECT * FROM matches WHERE kind = 'number'"))
def qual_numeric_match(spark, folder):
    current, truth = scored(spark, folder)
    keep = list(_NUMERIC)
    return quality.column_matches(current.select(*keep), truth.select(*keep))


@query("qual_string_match", oracle("orders_messy orders_twice", _SIDES + _MATCHES + "SELECT * FROM matches WHERE kind = 'text'"))
def qual_string_match(spark, folder):
    current, truth = scored(spark, folder)
    keep = list(_TEXT)
    return quality.column_matches(current.select(*keep), truth.select(*keep))


@query("qual_text_documents", """
WITH cur AS (SELECT lang, source, CASE WHEN doc_id % 6 = 0 THEN upper(text) ELSE text END AS text FROM documents),
ref AS (SELECT lang, source, text FROM documents), size AS (SELECT count(*) AS lo FROM ref)
""" + "\nUNION ALL ".join(text_match_sql(c) for c in ("lang", "source", "text")))
def qual_text_documents(spark, folder):
    docs = table(spark, folder, "documents")
    current = docs.selectExpr("lang", "source", "CASE WHEN doc_id % 6 = 0 THEN upper(text) ELSE text END AS text")
    return quality.column_matches(current, docs.select("lang", "source", "text"))


@query("qual_correctness", oracle("orders_messy orders_twice", _SIDES + _MATCHES
       + f"SELECT {clamp_sql(_CORRECT)} AS correctness FROM size"))
def qual_correctness(spark, folder):
    return quality.score_quality(*scored(spark, folder)).select("correctness")


@query("qual_completeness", oracle("orders_messy orders_twice", _SIDES + f"""
SELECT round({_NULL_SHARE}, 9) AS null_share, round({_COPY_SHARE}, 9) AS duplicate_share, round({_COMPLETE}, 9) AS completeness"""))
def qual_completeness(spark, folder):
    parts = quality.completeness(scored(spark, folder)[0])
    return parts.select(*[F.round(c, 9).alias(c) for c in parts.columns])


@query("qual_schema", f"SELECT round({_SCHEMA}, 6) AS schema_accuracy")
def qual_schema(spark, folder):
    current, truth = scored(spark, folder)
    return quality.score_quality(current, truth).select("schema_accuracy")


_OVERALL = f"""SELECT {clamp_sql(_CORRECT)} AS correctness, {clamp_sql(_COMPLETE)} AS completeness,
  {clamp_sql(_SCHEMA)} AS schema_accuracy,
  {clamp_sql(f'0.6 * ({_CORRECT}) + 0.3 * ({_COMPLETE}) + 0.1 * ({_SCHEMA})')} AS overall FROM size"""


@query("qual_overall", oracle("orders_messy orders_twice", _SIDES + _MATCHES + _OVERALL))
def qual_overall(spark, folder):
    return quality.score_quality(*scored(spark, folder))


def scored_set(spark, folder):
    current, truth = scored(spark, folder)
    customers = table(spark, folder, "customer").selectExpr("c_custkey AS k", "c_name AS name")
    tables = TableSet({"orders": current, "customers": customers},
                      (Relationship("orders", "cust", "customers", "k"),), primary="orders")
    return tables, {"orders": truth, "customers": customers, "absent": customers}


@query("qual_multi", oracle("orders_messy orders_twice", _SIDES + _MATCHES + f""", one AS ({_OVERALL}),
fk AS (SELECT count(CASE WHEN cust IN (SELECT c_custkey FROM customer) THEN 1 END) / count(cust) AS v FROM cur),
alls AS (SELECT * FROM one UNION ALL SELECT 0.9999, 0.9999, 0.9999, 0.9999 UNION ALL SELECT {EPS}, {EPS}, {EPS}, {EPS})
SELECT {clamp_sql('avg(correctness)')} AS correctness, {clamp_sql('avg(completeness)')} AS completeness,
  {clamp_sql('avg(schema_accuracy)')} AS schema_accuracy, {clamp_sql('0.9 * avg(overall) + 0.1 * (SELECT v FROM fk)')} AS overall,
  (SELECT {clamp_sql('v')} FROM fk) AS fk_integrity FROM alls"""))
def qual_multi(spark, folder):
    return quality.score_quality_set(*scored_set(spark, folder))


# --- validation -----------------------------------------------------------------------------

HINTS = {"price": "Some missing values: fill with median", "status": "Null where unknown", "cust": "Customer of the order"}
_RANGE = """SELECT 'RANGE_VIOLATION' AS rule, '{c}' AS "column",
  count(CASE WHEN {c} < lo - m OR {c} > hi + m THEN 1 END) = 0 AS passed, count(CASE WHEN {c} < lo - m OR {c} > hi + m THEN 1 END) AS violating
  FROM cur, (SELECT min({c}) AS lo, max({c}) AS hi, CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE (max({c}) - min({c})) * 0.1 END AS m FROM ref)
  GROUP BY lo, hi, m"""
_RULES = {
    "nulls": "\nUNION ALL ".join(f"""SELECT 'NULL_REMAINING' AS rule, '{c}' AS "column", count(*) = count({c}) AS passed,
      count(*) - count({c}) AS violating FROM cur""" for c in ("price", "status")),
    "duplicates": """SELECT 'DUPLICATES' AS rule, CAST(NULL AS VARCHAR) AS "column", count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM cur)) AS passed,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cur)) AS violating FROM cur""",
    "types": "\nUNION ALL ".join(
        f"SELECT 'TYPE_MISMATCH' AS rule, '{c}' AS \"column\", {'false' if c == 'flag' else 'true'} AS passed, 0 AS violating"
        for c in _COLUMNS),
    "range": "\nUNION ALL ".join(_RANGE.format(c=c) for c in _NUMERIC),
    "row_count": """SELECT 'ROW_COUNT' AS rule, CAST(NULL AS VARCHAR) AS "column", n / greatest(m, 1) BETWEEN 0.8 AND 1.2 AS passed, 0 AS violating FROM size""",
}
_NAMES = {"nulls": "NULL_REMAINING", "duplicates": "DUPLICATES", "types": "TYPE_MISMATCH", "range": "RANGE_VIOLATION", "row_count": "ROW_COUNT"}


def _report(spark, folder):
    current, truth = scored(spark, folder)
    return validate.validate_table(current, truth, HINTS)


def _rule_query(name: str):
    @query(f"valid_{name}", oracle("orders_messy orders_twice", _SIDES + "\n" + _RULES[name]))
    def run(spark, folder):
        return _report(spark, folder).where(F.col("rule") == _NAMES[name]).drop("detail")
    return run


for _name in _RULES:
    _rule_query(_name)
_ALL_RULES = "\nUNION ALL ".join(_RULES.values())


@query("valid_report", oracle("orders_messy orders_twice", _SIDES + f""", rules AS ({_ALL_RULES})
SELECT count(CASE WHEN passed THEN 1 END) AS rules_passed, count(*) AS rules_total,
  {clamp_sql('count(CASE WHEN passed THEN 1 END) / count(*)')} AS validation_score FROM rules"""))
def valid_report(spark, folder):
    return validate.validation_score(_report(spark, folder))


_FK_RULE = """SELECT 'orders' AS "table", 'FK_VIOLATION' AS rule, 'cust' AS "column",
  count(CASE WHEN cust NOT IN (SELECT c_custkey FROM customer) THEN 1 END) = 0 AS passed,
  count(CASE WHEN cust NOT IN (SELECT c_custkey FROM customer) THEN 1 END) AS violating FROM cur WHERE cust IS NOT NULL"""


@query("valid_multi", oracle("orders_messy orders_twice", _SIDES + f""", rules AS ({_ALL_RULES})
SELECT 'orders' AS "table", * FROM rules UNION ALL {_FK_RULE}
UNION ALL SELECT 'absent', 'MISSING_TABLE', NULL, false, 0
UNION ALL SELECT 'customers', rule, col, true, 0 FROM (VALUES ('DUPLICATES', NULL), ('TYPE_MISMATCH', 'k'), ('TYPE_MISMATCH', 'name'),
  ('RANGE_VIOLATION', 'k'), ('ROW_COUNT', NULL)) t(rule, col)"""))
def valid_multi(spark, folder):
    tables, truths = scored_set(spark, folder)
    return validate.validate_tables(tables, truths, {"orders": HINTS}).drop("detail")


@query("valid_fk", oracle("orders_messy orders_twice", _SIDES + "\n" + _FK_RULE + """
UNION ALL SELECT 'orders', 'FK_MISSING_TABLE', 'cust', false, 0 UNION ALL SELECT 'orders', 'FK_MISSING_COLUMN', 'cust', false, 0"""))
def valid_fk(spark, folder):
    tables, _ = scored_set(spark, folder)
    links = (*tables.relationships, Relationship("orders", "cust", "nowhere", "k"), Relationship("orders", "cust", "customers", "nothing"))
    return validate.validate_tables(TableSet(tables.tables, links), {}, {}).drop("detail")


# --- run logs -------------------------------------------------------------------------------

_STEPS = """
, walked AS (SELECT *, greatest(coalesce(max(quality) OVER before, 0), 0) AS best_before,
    sum(cost) OVER (PARTITION BY run_id ORDER BY step) AS used,
    lag(action_type) OVER (PARTITION BY run_id ORDER BY step) AS previous,
    row_number() OVER (PARTITION BY run_id, action_type, "column" ORDER BY step) AS nth
  FROM run_log WINDOW before AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, greatest(quality - best_before, 0) AS gain,
    CASE WHEN action_type = 'drop_duplicates' THEN coalesce(previous = 'drop_duplicates', false) ELSE nth > 1 END AS redundant FROM walked),
scored AS (SELECT *, CASE WHEN NOT valid THEN 0.5 WHEN quality < best_before - 0.001 THEN 0.3 + best_before - quality
    WHEN redundant THEN 0.1 ELSE 0 END AS penalty FROM marked)
"""


@query("log_gain", oracle("run_log", _STEPS + "SELECT run_id, step, round(best_before, 6) AS best_before, round(gain, 6) AS gain FROM scored"))
def log_gain(spark, folder):
    steps = runlog.score_steps(view(spark, folder, "run_log"))
    return steps.select("run_id", "step", F.round("best_before", 6).alias("best_before"), F.round("gain", 6).alias("gain"))


@query("log_reward", oracle("run_log", _STEPS + """SELECT run_id, step, round(penalty, 6) AS penalty,
  round(round(10 * gain, 6) - round(penalty, 6) - round(cost / greatest(initial_budget, 1), 6), 6) AS reward FROM scored"""))
def log_reward(spark, folder):
    steps = runlog.score_steps(view(spark, folder, "run_log"))
    return steps.select("run_id", "step", F.round("penalty", 6).alias("penalty"), F.round("reward", 6).alias("reward"))


@query("log_redundant", oracle("run_log", _STEPS + "SELECT run_id, step, redundant FROM scored"))
def log_redundant(spark, folder):
    return runlog.score_steps(view(spark, folder, "run_log")).select("run_id", "step", "redundant")


_ACTION = """(SELECT run_id, count(*) AS steps, count(*) - count(DISTINCT action_type || coalesce("column", '-')) AS repeated FROM run_log GROUP BY run_id)"""
_BUDGET = "(SELECT run_id, CAST(sum(cost) AS BIGINT) AS budget_used, max(initial_budget) AS initial_budget FROM run_log GROUP BY run_id)"


@query("log_action_quality", oracle("run_log", f"SELECT run_id, steps, repeated, round(1 - repeated / steps, 6) AS action_quality FROM {_ACTION}"))
def log_action_quality(spark, folder):
    return runlog.action_quality(view(spark, folder, "run_log")).withColumn("action_quality", F.round("action_quality", 6))


@query("log_efficiency", oracle("run_log", f"""SELECT run_id, budget_used, initial_budget,
  round(1 - budget_used / initial_budget, 6) AS efficiency FROM {_BUDGET}"""))
def log_efficiency(spark, folder):
    return runlog.efficiency(view(spark, folder, "run_log")).withColumn("efficiency", F.round("efficiency", 6))


def _final(spark, folder):
    log = view(spark, folder, "run_log")
    results = log.groupBy("run_id").agg(
        F.max_by("quality", "step").alias("quality"), F.avg(F.col("valid").cast("int")).alias("validation"),
        F.max("quality").alias("schema_accuracy"))
    return runlog.final_scores(log, results)


_FINAL = f"""
, parts AS (SELECT * FROM (SELECT run_id, arg_max(quality, step) AS quality, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS validation,
   max(quality) AS schema_accuracy FROM run_log GROUP BY run_id) JOIN {_BUDGET} USING (run_id) JOIN {_ACTION} USING (run_id)),
finals AS (SELECT *, 1 - budget_used / initial_budget AS efficiency, 1 - repeated / steps AS action_quality FROM parts),
scores AS (SELECT *, {clamp_sql('weighted')} AS score FROM (SELECT *, {' + '.join(f"{w} * {clamp_sql(c)}" for w, c in (
    ('0.40', 'quality'), ('0.20', 'validation'), ('0.15', 'efficiency'), ('0.10', 'action_quality'), ('0.15', 'schema_accuracy')))} AS weighted FROM finals))
"""


@query("log_final_score", oracle("run_log", _FINAL + "SELECT run_id, round(weighted, 8) AS weighted FROM scores"))
def log_final_score(spark, folder):
    return _final(spark, folder).select("run_id", F.round("weighted", 8).alias("weighted"))


@query("log_leaderboard", oracle("run_log", _FINAL + """SELECT run_id, round(score, 3) AS score, round(quality, 3) AS quality,
  round(validation, 3) AS validation, round(efficiency, 3) AS efficiency, steps,
  CAST(budget_used AS VARCHAR) || '/' || CAST(initial_budget AS VARCHAR) AS budget FROM scores"""))
def log_leaderboard(spark, folder):
    return runlog.leaderboard(_final(spark, folder))


@query("log_average_score", oracle("run_log", _FINAL + f"SELECT count(*) AS runs, round({clamp_sql('avg(score)')}, 5) AS average_score FROM scores"))
def log_average_score(spark, folder):
    return runlog.average_score(_final(spark, folder)).withColumn("average_score", F.round("average_score", 5))
