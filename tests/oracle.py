"""Compares a query's rows with its SQL on the same tables."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "tolist"):
        return cell(v.tolist())
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in v.items())
    return v if isinstance(v, str) else str(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(cell(r[i]) for i in at) for r in rows), key=repr)


def sql_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    return rows_of([d[0] for d in r.description], r.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql: str, sf_dir: str) -> str:
    names, got = spark_rows(df)
    want_names, want = sql_rows(sql, sf_dir)
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} and {len(want)} rows; only Spark: {sorted(a - b)[:3]}; only SQL: {sorted(b - a)[:3]}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{names}: {g} and {w}"
    return "" if got else "no rows"
