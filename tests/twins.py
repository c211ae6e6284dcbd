"""Runs queries and their SQL twins side by side."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(rows):
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple("" if v is None else str(v) for v in r))


def assert_twin(spark, con, f, sql, d=DATA):
    out = f(spark, d)
    cols = sorted(out.columns)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = rel.fetchall()
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert norm(map(tuple, out.select(*cols).collect())) == norm(tuple(r[i] for i in at) for r in want)
