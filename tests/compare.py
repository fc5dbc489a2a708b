"""Compare registered queries with their SQL twins; run as a script for a report.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def kinds(types) -> list[str]:
    names = {
        "int": "int", "integer": "int", "bigint": "bigint", "double": "double", "string": "string",
        "varchar": "string", "date": "date", "boolean": "boolean", "hugeint": "hugeint",
    }
    return [names.get(str(t).lower(), str(t).lower()) for t in types]


def compare(frame, connection, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when they agree."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    expected_types = dict(zip(columns, kinds(d[1] for d in result.description)))
    expected = rows_of(columns, result.fetchall())
    got_types = dict(zip(frame.columns, kinds(t for _, t in frame.dtypes)))
    got = rows_of(frame.columns, frame.collect())
    faults = []
    if got_types != expected_types:
        faults.append(f"types {sorted(got_types.items())} vs {sorted(expected_types.items())}")
    if got != expected:
        missing = [r for r in expected if r not in set(got)][:2]
        extra = [r for r in got if r not in set(expected)][:2]
        faults.append(f"rows {len(got)} vs {len(expected)}; only SQL {missing}; only Spark {extra}")
    if not got:
        faults.append("empty result")
    return faults


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from emporia.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark_sql_shuffle_partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            frame = query(spark, folder)
            frame.cache().count()
            took = time.time() - started
            if name in oracles:
                faults = compare(frame, connection, oracles[name])
            else:
                n = len(frame.collect())
                faults = [] if n else ["empty result"]
        except Exception as error:  # report and go on
            faults, took = [f"{type(error).__name__}: {str(error)[:600]}"], 0
        spark.catalog.clearCache()
        bad += bool(faults)
        print(f"{'BAD' if faults else 'ok '} {name} spark {took:.1f}s all {time.time() - started:.1f}s {'; '.join(faults)}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
