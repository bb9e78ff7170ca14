"""Compares every query with its SQL counterpart: ``python tests/compare.py 0.01 [name …]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, connection, folder: str, query, sql: str) -> str | None:
    """None when equal, else the first difference."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {frame.columns} / {columns}"
    if ours == theirs:
        return None if ours else "no rows"
    a, b = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    return f"{len(ours)} / {len(theirs)} rows, {len(a)} / {len(b)} only there; {a[:1]} / {b[:1]}"[:1500]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gistmill.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls = duck(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            verdict = compare(spark, connection, folder, query, sqls[name]) if name in sqls else "no SQL"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name:26s} {time.time() - start:6.2f}s {verdict or 'equal'}", flush=True)
