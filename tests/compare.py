"""Compare Spark results with DuckDB's, regardless of row and column order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _value(v):
    if v is None:
        return "-"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def normal(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """None when both give the same rows, else a short description."""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} oracle {sorted(names)}"
    theirs = normal(names, result.fetchall())
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"rows: spark {len(ours)} oracle {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(names)}\nspark  {a}\noracle {b}"
    return None
