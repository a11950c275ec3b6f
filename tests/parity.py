"""Compares a query with its SQL in DuckDB."""

import datetime

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat() if v.time() != datetime.time(0) else str(v.date())
    if isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return int(v) if type(v).__name__.startswith("int") else v


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr(tuple(value(v) for v in r)) for r in frame[columns].itertuples(index=False, name=None))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(df, sql: str, connection) -> None:
    have, want = df.toPandas().astype(object), connection.sql(sql).df().astype(object)
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)
