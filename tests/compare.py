"""Run registered queries beside their SQL and compare the results value by value.

    python -m tests.compare [folder of sample tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.12g}"))
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return repr(value)


def rows_of(columns, records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = sorted(tuple(_plain(record[i]) for i in order) for record in records)
    return [columns[i] for i in order], table


def run_spark(spark, query, sf_dir):
    df = query(spark, sf_dir)
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def run_sql(connection, sql):
    cursor = connection.execute(sql)
    return rows_of([column[0] for column in cursor.description], cursor.fetchall())


def difference(found, expected) -> str | None:
    if found[0] != expected[0]:
        return f"columns {found[0]} against {expected[0]}"
    if found[1] == expected[1]:
        return None
    only = sorted(set(found[1]) - set(expected[1]))[:2]
    missed = sorted(set(expected[1]) - set(found[1]))[:2]
    return f"{len(found[1])} rows against {len(expected[1])}; only here {only}; only there {missed}"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry
    from cordwood.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, sql, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            found = run_spark(spark, query, sf_dir)
            seconds = time.time() - started
            verdict = difference(found, run_sql(connection, sql[name])) if name in sql else "no SQL"
            size = len(found[1])
        except Exception as error:  # report and go on with the next query
            verdict, seconds, size = f"{type(error).__name__}: {str(error)[:600]}", 0.0, -1
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {size} rows {seconds:.2f}s {verdict or ''}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
