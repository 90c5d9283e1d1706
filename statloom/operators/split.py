"""Seeded train / evaluation splits and complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage, quoted, unused_names

HASHES = ("xxhash64", "md5")


def uniform(id_col: str, seed: int, hash_name: str = "xxhash64") -> Column:
    """A number in [0, 1) that depends only on the row's id and the seed; all NULL ids draw the same one."""
    key = F.col(quoted(id_col))
    if hash_name == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(2**53))
    if hash_name == "md5":
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    raise ValueError(f"hash must be one of {HASHES}")


def bernoulli_split(
    df: DataFrame,
    ratio: float = 0.8,
    seed: int = 1,
    id_col: str | None = None,
    hash_name: str = "xxhash64",
) -> tuple[DataFrame, DataFrame]:
    """Each row goes to the first part with probability `ratio`; the second is the rest.

    With an id the choice is a pure function of it, so both halves agree under
    any partitioning. Without one the draw is pinned before it is read twice.
    """
    (draw,) = unused_names(df, ["_draw"])
    if id_col is None:
        drawn = cut_lineage(df.withColumn(draw, F.rand(seed)))
    else:
        drawn = df.withColumn(draw, uniform(id_col, seed, hash_name))
    first = F.col(draw) < ratio
    return drawn.where(first).drop(draw), drawn.where(~first).drop(draw)


def exact_split(
    df: DataFrame,
    id_col: str,
    ratio: float = 0.8,
    seed: int = 1,
    hash_name: str = "xxhash64",
    take_rows: int = 50_000,
) -> tuple[DataFrame, DataFrame]:
    """A random part of exactly round(rows * ratio) rows, and the rest.

    The rows with the smallest (draw, id) are taken. The cut is found by
    narrowing an interval of draws by counts, so nothing is sorted as a whole.
    Rows of one draw, such as those that share an id or have none, are taken in
    the order of a hash of the whole row where the cut falls among them.
    """
    key = F.col(quoted(id_col))
    (draw,) = unused_names(df, ["_draw"])
    drawn = df.withColumn(draw, uniform(id_col, seed, hash_name))
    keys = drawn.select(F.col(draw).alias("_draw"), key.alias("_id"))
    total = keys.count()
    wanted = int(total * ratio + 0.5)
    if wanted <= 0:
        return df.limit(0), df
    if wanted >= total:
        return df, df.limit(0)

    cells = 4096
    low, width, skipped, inside = 0.0, 1.0, 0, total
    while inside > take_rows and width > 1e-14:
        cell = F.floor((F.col("_draw") - F.lit(low)) / F.lit(width / cells)).cast("int")
        window = (F.col("_draw") >= low) & (F.col("_draw") < low + width)
        counts = dict(keys.where(window).groupBy(cell.alias("c")).count().collect())
        for c in sorted(counts):
            if skipped + counts[c] >= wanted:
                low, width, inside = low + c * (width / cells), width / cells, counts[c]
                break
            skipped += counts[c]
    window = (F.col("_draw") >= low) & (F.col("_draw") < low + width)
    last = keys.where(window).orderBy("_draw", "_id").offset(wanted - skipped - 1).limit(1).first()["_draw"]
    below, level, above = (drawn.where(t).drop(draw) for t in (F.col(draw) < last, F.col(draw) == last, F.col(draw) > last))
    counts = keys.agg(F.count_if(F.col("_draw") < last).alias("below"), F.count_if(F.col("_draw") == last).alias("level")).first()
    needed = wanted - counts["below"]
    if needed == counts["level"]:
        return below.union(level), above
    whole = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    taken = level.orderBy(key, whole).limit(needed)
    return below.union(taken), above.union(level.exceptAll(taken))


def complement(df: DataFrame, part: DataFrame, id_col: str) -> DataFrame:
    """Rows of `df` whose id is not in `part`; a NULL id there stands for all of them."""
    other = part.select(F.col(quoted(id_col)).alias("_part_id")).distinct()
    return df.join(other, df[quoted(id_col)].eqNullSafe(other["_part_id"]), "left_anti")


def set_complement(df: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct rows of `df` that do not occur in `part`.

    Copies collapse inside their own tasks before the two sides meet.
    """
    return df.distinct().subtract(part.distinct())
