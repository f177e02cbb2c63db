"""Spark results against the same query in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """What differs in names, kinds of type, row count or any value; empty when all agree."""
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    out = []
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    types = dict(df.dtypes)
    for c in cur.description:
        if kinds.get(types[c[0]], "?") != str(c[1]):
            out.append(f"type of {c[0]}: {types[c[0]]} / {c[1]}")
    a, b = canonical(df.columns, got), canonical(want_cols, want)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return out + [f"{x} != {y}" for x, y in wrong[:limit]] + ([f"{len(wrong)} rows differ"] if wrong else [])
