"""Run registered queries and their SQL side by side."""

import os

import duckdb
import pandas as pd

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database() -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in sorted(os.listdir(TABLES)):
        if name.endswith(".parquet"):
            db.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{TABLES}/{name}'")
    return db


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{float(x):.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
