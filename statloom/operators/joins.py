"""Lookup joins that stay whole and balanced whatever the sizes and key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.session import known, quoted, small_frame, unused_names

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20
HOT_KEYS = 512


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has no more than `rows` rows and about `size` bytes, reading no further than that."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        value = F.col(quoted(field.name))
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            width = width + 32 * F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0))
        width = width + 16
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join of many `rows` with a `table` that is unique on `keys`.

    A table of checked size is broadcast and the rows do not move. A larger
    one is joined by shuffle, apart from the most frequent keys of `rows` and
    rows with a NULL key: at most `hot_keys` keys are frequent, so their table
    entries are broadcast, and no key left in the shuffle holds more than
    1/hot_keys of the rows.
    """
    if fits_broadcast(table, broadcast_rows):
        return rows.join(F.broadcast(table), keys, "left")

    count, flag = unused_names(rows, ["_rows", "_hot"])
    counted = rows.where(known(keys)).groupBy(*keys).agg(F.count("*").alias(count))
    frequent = counted.orderBy(F.desc(count)).limit(hot_keys).select(*keys)
    hot = small_frame(rows.sparkSession, frequent.collect(), frequent.schema)
    flagged = rows.join(F.broadcast(hot.withColumn(flag, F.lit(True))), keys, "left")
    apart = F.coalesce(F.col(flag), F.lit(False)) | ~known(keys)
    hot_table = table.join(F.broadcast(hot), keys, "left_semi")
    hot_part = flagged.where(apart).drop(flag).join(F.broadcast(hot_table), keys, "left")
    cold_part = flagged.where(~apart).drop(flag).join(table.hint("merge"), keys, "left")
    return hot_part.unionByName(cold_part)
