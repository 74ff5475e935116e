"""Compare a query's rows with its SQL on the same tables, in any order."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        path = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "normalize"):
        return float(v)
    return v


def same(df, sql, sf_dir=DATA):
    con = connect(sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=key)
    exp = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in order) for r in want), key=key)
    assert len(got) == len(exp)
    for a, b in zip(got, exp, strict=True):
        assert a == b
    return len(got)
