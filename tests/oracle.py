"""Compare a query with its DuckDB SQL: row count, column names, and values without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return int(v) if isinstance(v, int) else str(v)


def compare(spark, sf, query, sql, con=None):
    con = con or connect(sf)
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (len(bad), bad[:3])
    return len(got)
