"""Runs a query's SQL in DuckDB over the same Parquet tables, as the driver does."""

import glob
import os

import duckdb


def rows(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def normal(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns, expected = rows(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, expected)
