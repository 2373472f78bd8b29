"""Run a query in Spark and its oracle in DuckDB, and compare rows without order."""

import glob
import os

import duckdb


def norm(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(norm(y) for y in x)
    return x


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def check(df, sql, sf_dir):
    a, b = rows_spark(df), rows_duck(connect(sf_dir), sql)
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not bad, bad[:3]
    return len(a[1])
