"""Compare the registered queries with their SQL: ``python -m workload.check [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from workload.queries import QUERIES
from workload.sql import ORACLES


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tastegrid")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _row(values: tuple, order: list[int]) -> tuple:
    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return tuple(plain(values[i]) for i in order)


def compare(spark: SparkSession, connection, folder: str, name: str) -> str | None:
    """None if both engines agree, else what differs."""
    mine = QUERIES[name](spark, folder)
    got_columns = mine.columns
    got = [tuple(r) for r in mine.collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    result = connection.execute(ORACLES[name])
    want_columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} <> {sorted(want_columns)}"
    names = sorted(got_columns)
    left = sorted(_row(r, [got_columns.index(n) for n in names]) for r in got)
    right = sorted(_row(r, [want_columns.index(n) for n in names]) for r in want)
    if len(left) != len(right):
        return f"rows {len(left)} <> {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, {names}: {wrong[0][0]} <> {wrong[0][1]}" if wrong else None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection = local_session(), connect(folder)
    failures = 0
    for name in names:
        started = time.perf_counter()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.perf_counter() - started:6.2f}s {name} {problem or ''}")
        sys.stdout.flush()
    print(f"{len(names) - failures} of {len(names)} agree")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
