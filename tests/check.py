"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def compare(df, folder: str, sql: str) -> tuple[bool, str]:
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    names, want = oracle_rows(folder, sql)
    if sorted(names) != sorted(got_names):
        return False, f"columns {sorted(got_names)} != {sorted(names)}"
    a, b = rows_of(got_names, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows"
    diff = [x for x in zip(a, b) if x[0] != x[1]][:2]
    return False, f"{len(a)} vs {len(b)} rows; {sorted(names)}; {str(diff)[:700]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from textrep.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session("check")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                ok, note = compare(df, folder, oracle[name])
            else:
                ok, note = True, f"{len(df.collect())} rows, no sql"
        except Exception as error:  # the list goes on, the failure is printed
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
