"""Runs a query on Spark and its SQL form on DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet({glob.glob(f'{path}/*.parquet') if os.path.isdir(path) else [path]})")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict) or hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in (value if isinstance(value, dict) else value.asDict()).items()))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list]:
    """The number of rows, and what differs (at most a few)."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return len(mine), [("columns", sorted(df.columns), sorted(want.columns))]
    theirs = rows_of(want.columns, want.fetchall())
    if mine == theirs:
        return len(mine), []
    a, b = {}, {}
    for rows, into in ((mine, a), (theirs, b)):
        for r in rows:
            into[r] = into.get(r, 0) + 1
    return len(mine), [("rows", len(mine), len(theirs)), *[("spark", r) for r in a if a[r] != b.get(r)][:3], *[("sql", r) for r in b if b[r] != a.get(r)][:3]]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from lodestone.session import session

    at = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(cpus=8), connect(at)
    sqls = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if sys.argv[1:] and not any(name.startswith(x) for x in sys.argv[1:]):
            continue
        began = time.time()
        try:
            if name in sqls:
                n, off = compare(spark, con, query, sqls[name], at)
            else:
                n, off = len(query(spark, at).collect()), []
        except Exception as e:  # the others still run
            n, off = 0, [str(e)[-1500:]]
            print(f"{name}: {off[0]}", flush=True)
            bad.append(name)
            continue
        print(f"{name}: {n} rows, {'no SQL' if name not in sqls else 'same' if not off else off}, {time.time() - began:.1f} s", flush=True)
        if off or not n:
            bad.append(name)
    print("different or empty:", bad)
