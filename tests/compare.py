"""Rows of a Spark query against those of its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def cell(x):
    if x is None or x != x:
        return "\0"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.6f}"
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


def agree(spark, con, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
