"""Runs a query and its SQL over the same tables and compares the rows, as a multiset, and the columns."""

import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def compare(spark, sf_dir, run, sql, con=None):
    """None, or what differs."""
    con = con or tables(sf_dir)
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; {extra}"[:900]
    return next((f"{a} and {b}"[:900] for a, b in zip(got, want, strict=True) if a != b), None)
