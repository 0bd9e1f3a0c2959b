"""Run the registered queries next to their SQL in DuckDB and compare all rows.

    python check_oracles.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from tablewash.session import build_session
from tablewash.workloads import all_oracles, all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "is_finite"):
        return float(value)
    return value


def compare(spark_rows, spark_names, duck_rows, duck_names) -> str:
    if sorted(spark_names) != sorted(duck_names):
        return f"columns {sorted(spark_names)} / {sorted(duck_names)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    names = sorted(spark_names)
    left = sorted((tuple(normal(r[spark_names.index(n)]) for n in names) for r in spark_rows), key=repr)
    right = sorted((tuple(normal(r[duck_names.index(n)]) for n in names) for r in duck_rows), key=repr)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{opts.sf}/{t}.parquet'")
    oracles = all_oracles()
    failed = 0
    for name, fn in all_queries().items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        start = time.time()
        try:
            df = fn(spark, opts.sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"{name:28s} rows {len(rows):7d}  {took:6.2f}s  no SQL", flush=True)
                continue
            result = duck.sql(oracles[name])
            problem = compare(rows, df.columns, result.fetchall(), result.columns)
        except Exception as e:  # noqa: BLE001
            took, rows, problem = time.time() - start, [], f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{name:28s} rows {len(rows):7d}  {took:6.2f}s  {'ok' if not problem else 'FAIL ' + problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
