"""Compares a registered query with its SQL on the driver's tables, as the driver does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(y) for y in x) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(plain(y) for y in x.values()) + "}"
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf_dir: str, query, sql: str) -> int:
    """The number of rows, which are the same."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(ours) == len(theirs)
    assert ours == theirs, next((a, b) for a, b in zip(ours, theirs) if a != b)
    return len(ours)
