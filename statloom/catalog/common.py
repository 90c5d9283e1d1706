"""Shared pieces of the named queries and of the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def draw_sql(key: str, seed: int = 1) -> str:
    """The md5 draw of a row's id in [0, 1)."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
