"""Run registered queries on Spark and their SQL twins on DuckDB, and compare the rows.

    python -m checks.compare [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from changeflow import build_session
from checks.oracles import ORACLES
from checks.queries import QUERIES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def spark_rows(spark: SparkSession, name: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    df = QUERIES[name](spark, sf_dir)
    return sorted(df.columns), _rows(df.columns, df.collect())


def oracle_rows(con: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str | None:
    """What differs between Spark and the oracle, or ``None``."""
    columns, got = spark_rows(spark, name, sf_dir)
    oracle_columns, want = oracle_rows(con, name)
    if columns != oracle_columns:
        return f"columns {columns} != {oracle_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{columns}\n    got      {a}\n    expected {b}"
    return None if got else "no rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = oracle_connection(args.sf), 0
    for name in args.names or QUERIES:
        started = time.monotonic()
        try:
            problem = difference(spark, con, name, args.sf)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.monotonic() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
