"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    return x


def differences(df, con, sql: str) -> list[str]:
    columns = sorted(df.columns)
    got = Counter(plain(tuple(r[c] for c in columns)) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != columns:
        return [f"columns {columns} and {sorted(names)}"]
    order = [names.index(c) for c in columns]
    want = Counter(plain(tuple(r[i] for i in order)) for r in res.fetchall())
    out = []
    if got != want:
        out.append(f"{sum(got.values())} rows and {sum(want.values())}; columns {columns}")
        out += [f"only Spark: {x}"[:600] for x in list((got - want).elements())[:3]]
        out += [f"only SQL: {x}"[:600] for x in list((want - got).elements())[:3]]
    return out
