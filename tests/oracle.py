"""Compare registered queries with their SQL: ``python -m tests.oracle [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """One comparable form for values of both engines."""
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(value)
    return str(value)


def rows_of(frame_rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in frame_rows]
    return sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both sides agree in column names, kinds of values and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    wanted = rows_of(cursor.fetchall(), names)
    found = rows_of([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    if len(wanted) != len(found):
        return f"{len(found)} rows instead of {len(wanted)}"
    for mine, theirs in zip(found, wanted):
        if mine != theirs:
            return f"row {str(mine)[:300]} instead of {str(theirs)[:300]}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if kind in same and kinds[name] not in (same[kind], "NUMBER", "STRING") and kinds[name] != same[kind]:
            return f"column {name} is {kind} instead of {kinds[name]}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from reviewlens.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = database(folder), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                verdict = differences(df, con, sql[name]) or "same"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        ok = verdict == "same" or verdict.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - began:6.1f}s {name}: {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
