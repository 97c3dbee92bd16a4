"""Rows of a Spark query and of its DuckDB SQL in one form that can be compared."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if hasattr(x, "item"):
        return cell(x.item())
    return x


def shaped(columns: list[str], rows: list) -> tuple[list[str], list]:
    """Columns by name, rows in any fixed order."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def of_spark(df) -> tuple[list[str], list]:
    return shaped(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sf_dir: str, sql: str) -> tuple[list[str], list]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for f in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        got = db.execute(sql)
        return shaped([d[0] for d in got.description], got.fetchall())
