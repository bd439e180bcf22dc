"""Compares a query with its SQL in DuckDB, as the driver does: sorted columns, order of rows ignored."""

import glob
import math
import os
import sys

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def compare(spark, name, sf_dir):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    rel = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns), (sorted(cols), sorted(df.columns))
    order = sorted(cols)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[0]
    return len(got)
