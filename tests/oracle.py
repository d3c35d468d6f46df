"""Holds a Spark result against DuckDB's rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        x = float(value)
        return "nan" if math.isnan(x) else f"{round(x, 9) + 0.0:.9f}"
    return str(value)


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(df.columns)
    want, got = bag(theirs.fetchall(), names), bag(df.collect(), df.columns)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
