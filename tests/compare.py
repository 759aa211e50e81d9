"""Compares a query with its SQL as a set of rows, columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.10g}")
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, con) -> str:
    """Empty if both give the same rows."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want, got = rows_of(names, rel.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if want == got:
        return ""
    a, b = [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]
    return f"rows {len(got)} and {len(want)}\n  spark {a}\n  sql   {b}"
