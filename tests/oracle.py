"""Compare a query with its SQL: same columns, same rows, same values."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "item"):
        return normal(value.item())
    return str(value)


def multiset(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(normal(v) for v in row) for row in ordered.itertuples(index=False))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    a, b = multiset(spark_frame), multiset(sql_frame)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}"
    ka, kb = kinds(spark_frame), kinds(sql_frame)
    if ka != kb:
        return "types " + str({c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]})
    return None
