"""Compares a query with its SQL in DuckDB: columns, row count, and values without order."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.datetime)):
        return x
    if isinstance(x, float):
        return round(x, 6)
    return x


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def difference(df, con, sql: str) -> str:
    """Empty if the frame equals the SQL's result."""
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    kinds = {d[0]: str(d[1]) for d in out.description}
    expected = out.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    names = {"bigint": ("BIGINT",), "int": ("INTEGER",), "string": ("VARCHAR",), "double": ("DOUBLE",), "boolean": ("BOOLEAN",)}
    for name, kind in df.dtypes:
        if kind in names and kinds[name] not in names[kind]:
            return f"column {name}: {kind} != {kinds[name]}"
    got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(columns, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} != {b}"
    return ""
