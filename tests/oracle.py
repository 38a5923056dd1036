"""Compare a query with its oracle: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).tz_localize(None).isoformat()
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"
    ours, theirs = rows(spark_frame), rows(oracle_frame)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(spark_frame.columns)}: {a} != {b}"
    return None
