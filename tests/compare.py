"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return db


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, name, query, sql, directory):
    """None when equal, else what differs."""
    start = time.time()
    frame = query(spark, directory)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    problem = None
    if sorted(frame.columns) != sorted(names):
        problem = f"columns {sorted(frame.columns)} != {sorted(names)}"
    else:
        a, b = rows_of(frame.columns, got), rows_of(names, want)
        if len(a) != len(b):
            problem = f"rows {len(a)} != {len(b)}; {sorted(set(map(repr, a)) ^ set(map(repr, b)))[:4]}"
        elif a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            problem = f"{len(bad)} rows differ, first {bad[0]}"
    return problem, len(got), took


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    directory = f"/root/testdata/sf{sf}"
    spark, db = session(), connect(directory)
    wanted = sys.argv[2:]
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                start = time.time()
                print(f"rows-only {name}: {query(spark, directory).count()} {time.time() - start:.1f}s", flush=True)
                continue
            problem, n, took = compare(spark, db, name, query, sql, directory)
        except Exception as error:
            problem, n, took = str(error)[:1500], 0, 0
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok'} {name}: {n} rows {took:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
