"""Comparing a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def duck_rows(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con.execute(sql).fetchdf()


def canonical(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)

    def text(v):
        if v is None or v != v:
            return ""
        return f"{v:.9f}" if isinstance(v, float) else str(v)

    return columns, sorted(tuple(map(text, row)) for row in frame[columns].itertuples(index=False))
