"""Compare registered queries with their SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ").split("+")[0]
    return repr(float(v)) if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    a = table(df.columns, [tuple(r) for r in df.collect()])
    b = table(*expected(sql, sf_dir))
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if a[1] != b[1]:
        x, y = set(a[1]), set(b[1])
        return f"{len(a[1])} / {len(b[1])} rows; only ours {list(x - y)[:2]}, only SQL {list(y - x)[:2]}"
    return ""
