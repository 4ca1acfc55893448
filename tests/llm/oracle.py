"""Compare a query with its DuckDB text over the tables of a folder."""

import duckdb


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x != x else str(x) for x in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


def same(spark, query, sql, folder):
    con = duckdb.connect()
    from pathlib import Path

    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    got, want = query(spark, str(folder)).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
