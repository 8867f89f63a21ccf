"""Runs registered queries against their SQL twins and reports every difference.

    python tests/compare.py [sf folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return repr(float(v)) if v != int(v) or abs(v) > 1e15 else repr(float(int(v)))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in rows), [columns[k] for k in order]


def compare(spark, con, name, folder):
    import __spark_entry__ as e
    df = e.queries()[name](spark, folder)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want, wcols = rows_of(cols, cur.fetchall())
    if gcols != wcols:
        return len(got), f"columns {gcols} != {wcols}"
    sparks = dict(df.dtypes)
    ducks = {d[0]: str(d[1]).lower() for d in cur.description}
    same = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean", "date": "date"}
    odd = {k: (sparks[k], ducks[k]) for k in sparks if same.get(sparks[k], sparks[k]) != ducks[k]}
    if odd:
        print("   types", name, odd)
    if got != want:
        gs, ws = set(got), set(want)
        a, b = [r for r in got if r not in ws], [r for r in want if r not in gs]
        return len(got), f"rows {len(got)} vs {len(want)}; spark only {len(a)} {a[:3]}; sql only {len(b)} {b[:3]}"
    return len(got), ""


if __name__ == "__main__":
    from tidegauge.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            count, diff = compare(spark, con, n, folder)
        except Exception as ex:  # noqa: BLE001
            count, diff = -1, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(diff)
        print(f"{'no-sql' if diff is None else 'ok' if not diff else 'DIFF'} {n} rows={count} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad", bad)
