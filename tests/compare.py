"""Run a named query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t)
    )


def compare(spark, sf_dir, query, sql):
    """Returns (number of rows, list of problems)."""
    df = query(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck(sf_dir).execute(sql)
    right = rows_of([d[0] for d in result.description], result.fetchall())
    problems = []
    if left[0] != right[0]:
        problems.append(f"columns {left[0]} vs {right[0]}")
    elif len(left[1]) != len(right[1]):
        problems.append(f"{len(left[1])} rows vs {len(right[1])}")
    if not problems and left[1] != right[1]:
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        problems.append(f"{len(bad)} rows differ, first {bad[0][0]} vs {bad[0][1]}")
    elif problems and left[0] == right[0]:
        extra = list(set(left[1]) - set(right[1]))[:2], list(set(right[1]) - set(left[1]))[:2]
        problems.append(f"only spark {extra[0]} only sql {extra[1]}")
    return len(left[1]), problems
