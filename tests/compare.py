"""Run registered queries next to their SQL counterparts.

`python tests/compare.py <folder> [query ...]` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    if actual == expected:
        return ""
    only_a = sorted(set(actual) - set(expected))[:3]
    only_e = sorted(set(expected) - set(actual))[:3]
    return f"{len(actual)} rows != {len(expected)}; spark only {only_a}; sql only {only_e}"[:1500]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from kinfold.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con = connect(folder)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        if name not in oracles:
            print(f"rows  {name} {len(fn(spark, folder).collect())} {time.time() - start:.1f}s", flush=True)
            continue
        try:
            problem = compare(fn(spark, folder), con, oracles[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {e}"[:800]
        print(f"{'ok   ' if not problem else 'DIFF '} {name} {time.time() - start:.1f}s {problem}", flush=True)
