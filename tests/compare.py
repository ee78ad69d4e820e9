"""Compares a query with its SQL, as sorted rows with columns by name."""

from __future__ import annotations

import math

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 5)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return str(v) if not isinstance(v, (int, type(None), bool)) else v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return ""
