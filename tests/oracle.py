"""Comparison of a query with its DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def same_rows(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
