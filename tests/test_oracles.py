import glob
import math
import os

import duckdb
import pytest

from arbor.plans import registry as R

DIR = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_equals_sql(spark, name):
    df = R.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    rel = con.execute(R.ORACLES[name])
    cols = [c[0] for c in rel.description]
    order = sorted(cols)
    assert order == sorted(df.columns)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[0]


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - set(R.ORACLES)))
def test_gives_rows(spark, name):
    assert R.QUERIES[name](spark, DIR).count() > 0
