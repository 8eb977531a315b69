"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def normal(value):
    if value is None:
        return ("0", "")
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else repr(round(value, 9) + 0.0))
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, int):
        return ("n", repr(float(value)))
    return ("s", str(value))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


def duck_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall(), [str(d[1]) for d in cur.description]


def compare(spark, sf_dir: str, fn, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    names, theirs, _ = duck_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, ours), rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}" if wrong else None
