"""Compare registered queries with their SQL twins: python tests/oracle.py [sf_dir] [name ...]."""

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


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t_spark = time.time() - t
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    t_sql = time.time() - t
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    elif got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0]}")
    return problems, len(got), t_spark, t_sql


if __name__ == "__main__":
    import __spark_entry__ as entry
    from segmark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf)
    sqls = entry.oracle_sql()
    chosen = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in chosen:
        try:
            problems, n, a, b = compare(spark, con, sf, name, entry.queries()[name], sqls[name])
        except Exception as exc:
            problems, n, a, b = [f"{type(exc).__name__}: {str(exc)[:700]}"], -1, 0, 0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} spark={a:.2f}s sql={b:.2f}s {' '.join(problems)[:1200]}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
