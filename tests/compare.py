"""Comparison of a Spark result with its SQL equivalent, order of rows and columns ignored."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([_cell(v) for v in value])
    return repr(value)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    """Empty text if equal, otherwise a short description of the difference."""
    ours = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normal_rows(names, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])} rows; " + _sample(ours[1], theirs[1])
    if ours[1] != theirs[1]:
        return _sample(ours[1], theirs[1])
    return ""


def _sample(ours, theirs) -> str:
    a, b = set(ours), set(theirs)
    return f"only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
