"""Run queries next to their SQL and compare: python -m workload.check SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool,)):
        return str(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if isinstance(value, str):
        return "s:" + value
    return repr(number + 0.0)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def compare(spark_frame: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text if equal, else what differs."""
    ours, theirs = spark_frame.toPandas(), db.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    left, right = rows_of(ours), rows_of(theirs)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        short = [tuple(cell[:60] for cell in row) for row in different[0]]
        return f"{len(different)} of {len(left)} rows differ, first {short}"
    return ""


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    cores = "local[8]"
    spark = (
        SparkSession.builder.master(cores)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failures = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(frame, db, ORACLES[name])
            else:
                problem = "" if frame.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{name:20s} {kind} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
