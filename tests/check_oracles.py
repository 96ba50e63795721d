"""Run every registered query against its oracle and report differences.

    python tests/check_oracles.py [name ...]        (data folder: $CHECK_SF_DIR)
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle_connection(folder: str = FOLDER):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads to 8")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(rows, names):
    """Rows as sorted tuples with the columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, build, sql, folder: str = FOLDER):
    """(rows, problem or None, seconds) of one query."""
    began = time.time()
    df = build(spark, folder)
    spark_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - began
    got = canonical(spark_rows, df.columns)
    if sql is None:
        return len(got), None, seconds
    watch = threading.Timer(60, con.interrupt)
    watch.start()
    try:
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = canonical(cursor.fetchall(), names)
    finally:
        watch.cancel()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}", seconds
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return len(got), f"{len(got)} rows against {len(want)}; only Spark {extra}; only oracle {lacking}", seconds
    return len(got), None, seconds


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = oracle_connection()
    builds, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or builds:
        try:
            rows, problem, seconds = compare(spark, con, name, builds[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            rows, problem, seconds = 0, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:32} {rows:8} rows {seconds:6.1f}s {'' if name in sqls else '(no oracle)'} {problem or ''}", flush=True)
    print(f"{len(names or builds)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
