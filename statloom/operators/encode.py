"""Category encodings and row numbering."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.joins import lookup_join
from statloom.session import bounded_rows, cut_lineage, quoted, small_frame, unused_names

# Fixed value: column names of one-hot features start with this.
ONE_HOT_PREFIX = "linreg_ohe_"

INLINE_LEVELS = 64
MAX_ONE_HOT_LEVELS = 1_000
NUMBERED_ROWS = 1_000_000


def category_levels(df: DataFrame, columns: list[str], limit: int = MAX_ONE_HOT_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of every column, found in one job."""
    if not columns:
        return {}
    pairs = [F.struct(F.lit(i).alias("f"), F.col(quoted(c)).cast("string").alias("v")) for i, c in enumerate(columns)]
    found = df.select(F.inline(F.array(*pairs))).where("v IS NOT NULL").distinct()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in bounded_rows(found, limit * len(columns), "distinct category values"):
        levels[columns[row.f]].append(row.v)
    return {c: sorted(v) for c, v in levels.items()}


def level_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many distinct known values each column has, in one job."""
    pairs = [F.struct(F.lit(i).alias("f"), F.col(quoted(c)).cast("string").alias("v")) for i, c in enumerate(columns)]
    found = df.select(F.inline(F.array(*pairs))).where("v IS NOT NULL").distinct().groupBy("f").count().collect()
    counted = {r.f: r["count"] for r in found}
    return {c: counted.get(i, 0) for i, c in enumerate(columns)}


def one_hot_name(column: str, level: str) -> str:
    return f"{ONE_HOT_PREFIX}{column}_{level}"


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = False) -> DataFrame:
    """Add one 0/1 column per level; a value unseen at fit gives zeros everywhere."""
    added = [
        F.when(F.col(quoted(c)) == F.lit(v), 1).otherwise(0).alias(one_hot_name(c, v))
        for c, values in levels.items()
        for v in (values[1:] if drop_first else values)
    ]
    return df.select("*", *added)


def one_hot_sparse(df: DataFrame, column: str, index: str = "index", size: str = "size") -> DataFrame:
    """Add the place (from 0) of a value's 1 among the columns that `one_hot` would make, and their number, for any number of levels."""
    for name in (index, size):
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"column {name!r} is there already; choose another result name")
    levels = ordinal_levels(df, column)
    coded = levels.select(F.col("level").alias(column), (F.col("code") - 1).alias(index))
    return lookup_join(df, coded, [column]).select(*[quoted(c) for c in df.columns], quoted(index), F.lit(levels.count()).cast("long").alias(size))


def ordinal_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of `column` with their 1-based position in sorted order."""
    distinct = df.select(F.col(quoted(column)).alias("level")).dropna().distinct()
    return number_rows(distinct, ["level"], "code")


def ordinal(df: DataFrame, columns: list[str], out: dict[str, str] | None = None) -> DataFrame:
    """Add each column's 1-based rank among its sorted distinct values.

    `out` names the result columns (default: replace the column). Few levels
    become an inline lookup; many are joined as a table.
    """
    out = out or {c: c for c in columns}
    distinct = {
        c: df.select(F.col(quoted(c)).alias("level")).dropna().distinct().limit(INLINE_LEVELS + 1).collect()
        for c in columns
    }
    names = df.columns
    (code,) = unused_names(df.select("*", *[F.lit(None).alias(v) for v in out.values() if v not in df.columns]), ["_code"])
    for c in columns:
        if len(distinct[c]) <= INLINE_LEVELS:
            df = apply_ordinal(df, c, sorted(r.level for r in distinct[c]), out[c])
        else:
            coded = ordinal_levels(df, c).select(F.col("level").alias(c), F.col("code").alias(code))
            joined = lookup_join(df, coded, [c]).withColumn(code, F.col(code).cast("int"))
            df = joined.drop(c).withColumnRenamed(code, c) if out[c] == c else joined.withColumnRenamed(code, out[c])
    return df.select(*[quoted(c) for c in names], *[quoted(out[c]) for c in columns if out[c] not in names])


def apply_ordinal(df: DataFrame, column: str, levels: list, out: str) -> DataFrame:
    """Rank of the value among known `levels`; NULL for an unseen value."""
    if not levels:
        return df.withColumn(out, F.lit(None).cast("int"))
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(quoted(column)))
    return df.withColumn(out, F.when(place > 0, place).cast("int"))


def number_rows(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Dense 1-based row numbers in the given order, without a single-task sort.

    Rows are range-partitioned and sorted locally, in as many partitions as keep one near
    NUMBERED_ROWS rows; each partition's numbers start after the counts of the earlier
    ones. The row's place in the scan breaks ties, so copies of one key spread over
    partitions. A column named `out` is replaced; all others stay, whatever their names.
    """
    spark = df.sparkSession
    partitions = partitions or max(1, -(-df.count() // NUMBERED_ROWS))
    seen, place, part_name, start = unused_names(df, ["_seen", "_place", "_part", "_start"])
    keys = [F.col(quoted(c)) for c in order] + [F.col(quoted(seen))]
    placed = (
        df.withColumn(seen, F.monotonically_increasing_id())
        .repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .drop(seen)
        .withColumn(place, F.monotonically_increasing_id())
    )
    pinned = cut_lineage(placed)
    part = F.shiftright(F.col(quoted(place)), 33).cast("int")
    counts = dict(pinned.groupBy(part.alias("p")).count().collect())
    parts = sorted(counts)
    starts = [0, *accumulate(counts[p] for p in parts)]
    offsets = small_frame(spark, list(zip(parts, starts)), f"{quoted(part_name)} int, {quoted(start)} long")
    local = F.col(quoted(place)).bitwiseAND(F.lit(2**33 - 1))
    numbered = pinned.withColumn(part_name, part).join(F.broadcast(offsets), part_name)
    kept = [F.col(quoted(c)) for c in df.columns if c.lower() != out.lower()]
    return numbered.select(*kept, (F.col(quoted(start)) + local + 1).alias(out))
