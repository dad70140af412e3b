"""Holds a query's rows against those of DuckDB."""

import glob
import os

import duckdb


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


def compare(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want, got = norm(cur.fetchall(), names), norm([tuple(r) for r in df.collect()], df.columns)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
    return len(got)
