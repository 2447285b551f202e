"""Compare registered queries with their check SQL run by DuckDB on the same files.

Usage: python -m tests.compare [sf] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"DEC{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return len(got), "rows only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if a == b:
        return len(got), "ok"
    sa, sb = set(a), set(b)
    return len(got), (f"DIFF {len(a)} vs {len(b)} rows; spark-only {len(sa - sb)} e.g. {sorted(sa - sb)[:2]}; "
                      f"sql-only {len(sb - sa)} e.g. {sorted(sb - sa)[:2]}")


def main():
    from confab import session
    from confab.plans import load

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    spark = session.build("compare", os.environ.get("BENCH_CPUS", "8"))
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        t = time.time()
        try:
            n, note = check(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            n, note = -1, "ERROR " + "".join(traceback.format_exception_only(e))[:900]
        bad += note not in ("ok", "rows only")
        print(f"{name:36s} {n:8d} rows {time.time() - t:6.1f}s {note[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
