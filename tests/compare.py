"""Compare a Spark result with the result of SQL text on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (2, round(value, 9) + 0.0)
    if isinstance(value, int):
        return (2, float(value))
    return (3, str(value))


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_key(r[i]) for i in order) for r in rows
    )


def mismatch(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    ours_c, ours = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    theirs_c, theirs = normal(cur.fetchall(), [d[0] for d in cur.description])
    if ours_c != theirs_c:
        return f"columns {ours_c} != {theirs_c}"
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"rows {len(ours)} vs {len(theirs)}; only ours {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
