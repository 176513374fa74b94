"""Compare a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if not isinstance(v, int) else v


def rows(columns, found):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in found), key=repr)


def check(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{source}'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, expected)
