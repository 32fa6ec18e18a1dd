"""Runs every query next to its SQL and compares the rows: ``python -m verification.check``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from verification.oracle import ORACLES
from verification.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def spark_rows(frame) -> tuple[list[str], Counter]:
    columns = sorted(frame.columns)
    return columns, Counter(tuple(row) for row in frame.select(*columns).collect())


def oracle_rows(connection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


def compare(frame, connection, sql: str) -> str:
    """An empty string when a query's rows and those of its SQL agree, else what differs."""
    columns, rows = spark_rows(frame)
    expected_columns, expected = oracle_rows(connection, sql)
    if columns != expected_columns:
        return f"columns {columns} instead of {expected_columns}"
    if rows != expected:
        extra = list((rows - expected).items())[:2]
        missing = list((expected - rows).items())[:2]
        return f"{rows.total()} rows for {expected.total()}; extra {extra}; missing {missing}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names or list(ORACLES):
        started = time.time()
        difference = compare(REGISTRY[name](spark, sf_dir), connection, ORACLES[name])
        failures += bool(difference)
        print(f"{name}: {difference or 'ok'} ({time.time() - started:.1f} s)", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
