"""Side-by-side comparison of a registered query with its SQL counterpart."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def differences(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty when names, types, row counts and every value agree."""
    got_names, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} vs {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows vs {len(want)}"]
    out = [f"{g} vs {w}" for g, w in zip(got, want, strict=True) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return out[:limit] + ([f"... {len(out)} rows differ"] if len(out) > limit else [])
