"""Runs registered queries and their SQL side by side: python tests/compare.py SF [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value if value is None or isinstance(value, (int, bool)) else str(value)


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(query, statement: str, spark, connection, sf_dir: str) -> tuple[str, float, float]:
    """Empty text if both sides agree, else what differs; with both run times."""
    start = time.time()
    frame = query(spark, sf_dir)
    found = rows_of(frame.columns, frame.collect())
    middle = time.time()
    result = connection.execute(statement)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    times = (middle - start, time.time() - middle)
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}", *times
    if found != expected:
        a, b = set(found), set(expected)
        return (
            f"rows {len(found)} / {len(expected)}; only spark {sorted(a - b, key=repr)[:2]}; "
            f"only sql {sorted(b - a, key=repr)[:2]}",
            *times,
        )
    return "" if found else "EMPTY", *times


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, connection = local_session(), oracle(sf_dir)
    queries, statements = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        try:
            if name in statements:
                text, a, b = difference(queries[name], statements[name], spark, connection, sf_dir)
                print(f"{'OK  ' if not text else 'FAIL'} {name} spark {a:.1f}s sql {b:.1f}s {text[:900]}", flush=True)
            else:
                start = time.time()
                count = len(queries[name](spark, sf_dir).collect())
                text = ""
                print(f"ROWS {name} {count} {time.time() - start:.1f}s", flush=True)
        except Exception as error:
            text = "error"
            print(f"ERR  {name} {type(error).__name__} {str(error)[:1200]}", flush=True)
        bad += bool(text)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
