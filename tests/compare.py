"""Rows of a query against DuckDB on the same tables."""

import glob
import os

import duckdb


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"}).values))


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(df.toPandas()) == rows(con.execute(sql).df())
