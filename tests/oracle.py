"""Compare a query with its DuckDB text over the tables of a folder."""

from pathlib import Path

import duckdb


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return f"{float(x):.9g}"
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, row)) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def differences(spark, query, sql, folder, con=None):
    got, want = query(spark, str(folder)).toPandas(), (con or connect(folder)).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b), key=str)[:3]}, only there {sorted(set(b) - set(a), key=str)[:3]}"
    return "" if len(a) else "no rows"
