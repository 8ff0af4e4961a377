"""Side-by-side check of a registered query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, datetime.datetime):
        return "time"
    return type(value).__name__


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    kinds = [next((k for k in (_kind(r[i]) for r in rows) if k), None) for i in order]
    return [names[i] for i in order], kinds, sorted(body, key=repr)


def compare(spark, sf_dir, fn, sql):
    """Returns (rows, list of differences)."""
    df = fn(spark, sf_dir)
    names, kinds, rows = _table(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf_dir).execute(sql)
    want_names, want_kinds, want = _table([d[0] for d in result.description], result.fetchall())
    problems = []
    if names != want_names:
        problems.append(f"columns {names} != {want_names}")
    if kinds != want_kinds:
        problems.append(f"types {dict(zip(names, kinds))} != {dict(zip(want_names, want_kinds))}")
    if len(rows) != len(want):
        problems.append(f"rows {len(rows)} != {len(want)}")
    differ = [(a, b) for a, b in zip(rows, want) if a != b]
    if differ:
        problems.append(f"{len(differ)} rows differ, first {differ[0][0]} != {differ[0][1]}")
    return len(rows), problems
