"""Run a query and its SQL over one folder of tables and give both as sorted lists of rows."""

from __future__ import annotations

import duckdb

from evidra.sources.readers import TABLES


def one(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "item") and getattr(v, "shape", ()) == ():
        return one(v.item())
    if isinstance(v, float):
        return repr(round(v, 7) + 0.0)
    return str([one(x) for x in v]) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in data)


def both(spark, f, sql, sf):
    df = f(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    return rows(df.columns, df.collect()), rows([d[0] for d in got.description], got.fetchall())
