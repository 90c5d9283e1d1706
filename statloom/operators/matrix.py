"""Matrices as DataFrames: wide (an id and one column per component) or (i, k, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import session
from statloom.functions.scores import EXPRESSION_TERMS, linear
from statloom.operators.encode import number_rows
from statloom.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from statloom.session import as_frame, bounded_rows, number, quoted, small_frame, unused_names

#: Columns of a wide table; taller matrices are transposed in blocks.
MAX_MATRIX_COLUMNS = 4_000
#: Rows and columns of a block.
BLOCK = 512
#: Cells of one k that meet in one part of a join.
HOT_ROWS = 1_000_000


def get_column_names(spark: SparkSession, table: DataFrame | str) -> list[str]:
    return as_frame(spark, table).columns


def get_number_of_rows(spark: SparkSession, table: DataFrame | str) -> int:
    return as_frame(spark, table).count()


def multiply_matrices(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """A·B for wide matrices; the result has `id_col` and x1..xm.

    The right matrix has as many rows as the left has columns, so it is as
    small as a row of the left and travels inside the projection: no join and
    no shuffle, whatever the height of the left matrix.
    """
    left = [c for c in a.columns if c != id_col]
    right = [c for c in b.columns if c != id_col]
    rows = b.select(id_col, *[number(c).alias(f"b{i}") for i, c in enumerate(right)]).limit(len(left) + 1).collect()
    if len(rows) != len(left):
        many = "more" if len(rows) > len(left) else str(len(rows))
        raise ValueError(f"dimension mismatch: {len(left)} columns on the left, {many} rows on the right")
    rows.sort(key=lambda r: r[id_col])
    factor = np.array([[r[f"b{j}"] for j in range(len(right))] for r in rows], dtype=float)
    values = [session.number_sql(c) for c in left]
    if factor.size <= EXPRESSION_TERMS:
        products = [
            linear(values, factor[:, j], 0.0).alias(f"x{j + 1}")
            for j in range(factor.shape[1])
        ]
        return a.select(id_col, *products)

    @F.pandas_udf("array<double>")
    def times(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.array([np.asarray(p, dtype=float) for p in points]) @ factor))

    product = a.select(id_col, times(F.expr(f"array({', '.join(values)})")).alias("_row"))
    return product.select(id_col, *[F.col("_row")[j].alias(f"x{j + 1}") for j in range(factor.shape[1])])


def to_coordinates(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Wide to (i, k, v), with k counted from 1."""
    cells = [
        F.struct(F.lit(k + 1).alias("k"), number(c).alias("v"))
        for k, c in enumerate(c for c in df.columns if c != id_col)
    ]
    return df.select(F.col(quoted(id_col)).alias("i"), F.inline(F.array(*cells)))


def to_wide(cells: DataFrame, columns: list, id_col: str = "id", prefix: str = "x") -> DataFrame:
    """(i, k, v) to wide, one column per entry of `columns`."""
    summed = cells.groupBy("i").pivot("k", columns).agg(F.max("v"))
    return summed.select(F.col("i").alias(id_col), *[F.col(f"`{c}`").alias(f"{prefix}{n + 1}") for n, c in enumerate(columns)])


def transpose(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Wide to wide: one row per column of the input, one column per input row (`transpose_blocks` for more rows)."""
    ids = [r[0] for r in bounded_rows(df.select(id_col), MAX_MATRIX_COLUMNS, "rows to become columns")]
    cells = to_coordinates(df, id_col).select(F.col("k").alias("i"), F.col("i").alias("k"), "v")
    return to_wide(cells, sorted(ids), id_col)


def transpose_coordinates(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("k").alias("i"), F.col("i").alias("k"), "v")


def to_blocks(df: DataFrame, id_col: str = "id", size: int = BLOCK) -> DataFrame:
    """Wide to blocks (bi, bj, rows, columns, v): at most size x size cells each, row by row, counted from 0.

    Rows are numbered in the order of their ids, so a matrix may have any height.
    """
    names = [c for c in df.columns if c != id_col]
    place, part = unused_names(df, ["_place", "_cells"])
    numbered = number_rows(df.select(quoted(id_col), *[number(c).alias(c) for c in names]), [id_col], place)
    groups = [names[i : i + size] for i in range(0, len(names), size)]
    pieces = [F.struct(F.lit(j).alias("bj"), F.array(*[F.col(quoted(c)) for c in g]).alias("v")) for j, g in enumerate(groups)]
    at = F.col(quoted(place)) - 1
    cells = numbered.select(F.floor(at / size).alias("bi"), (at % size).cast("int").alias("r"), F.inline(F.array(*pieces)))
    packed = cells.groupBy("bi", "bj").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias(part))
    columns = F.size(F.col(part)[0]["v"])
    return packed.select("bi", "bj", F.size(part).alias("rows"), columns.alias("columns"), F.flatten(F.col(f"{part}.v")).alias("v"))


def transpose_blocks(blocks: DataFrame) -> DataFrame:
    """The transposed matrix in blocks; none is moved."""
    turned = F.expr("flatten(transform(sequence(0, columns - 1), c -> transform(sequence(0, rows - 1), r -> get(v, r * columns + c))))")
    return blocks.select(F.col("bj").cast("long").alias("bi"), F.col("bi").alias("bj"), F.col("columns").alias("rows"), F.col("rows").alias("columns"), turned.alias("v"))


def from_blocks(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks to (i, k, v), counted from 1."""
    each = blocks.select("bi", "bj", "columns", F.posexplode("v").alias("at", "v"))
    row = F.col("bi").cast("long") * size + F.floor(F.col("at") / F.col("columns")) + 1
    return each.select(row.alias("i"), (F.col("bj").cast("long") * size + F.col("at") % F.col("columns") + 1).alias("k"), "v")


def multiply_coordinates(a: DataFrame, b: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sparse product of (i, k, v) and (k, j, v): sums over k, as (i, j, v).

    Cells are summed per coordinate first, so copies never meet in the join, and a right
    side of checked size is broadcast. Else a k with more than `hot_rows` cells on a side is
    cut there into parts by the hash of the other coordinate; its cells on the other side
    are repeated once for each part, those of all other k only once.
    """
    left = a.groupBy("i", "k").agg(F.sum("v").alias("va"))
    right = b.groupBy("k", "j").agg(F.sum("v").alias("vb"))
    if fits_broadcast(right, BROADCAST_ROWS):
        met = left.join(F.broadcast(right), "k")
    else:
        met = salted(left, right, hot_rows)
    return met.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def salted(left: DataFrame, right: DataFrame, hot_rows: int) -> DataFrame:
    """The join on k of (i, k, va) and (k, j, vb), hot k in a grid of parts."""

    def parts(side: DataFrame, name: str) -> DataFrame:
        counted = side.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        return counted.select("k", F.ceil(F.col("n") / hot_rows).cast("int").alias(name))

    hot = parts(left, "pl").join(parts(right, "pr"), "k", "full")
    hot = hot.select("k", F.coalesce("pl", F.lit(1)).alias("pl"), F.coalesce("pr", F.lit(1)).alias("pr"))

    def dealt(side: DataFrame, other: str, own: str, across: str, own_salt: str, across_salt: str) -> DataFrame:
        told = lookup_join(side, hot, ["k"])
        mine = F.pmod(F.xxhash64(other), F.coalesce(own, F.lit(1))).cast("int").alias(own_salt)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1)).alias(across_salt)
        return told.select(*side.columns, mine, every)

    return dealt(left, "i", "pl", "pr", "sl", "sr").join(dealt(right, "j", "pr", "pl", "sr", "sl").hint("merge"), ["k", "sl", "sr"])


def cross_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """X'X of a wide table as (i, j, v), counted from 1; the rows never move."""
    from statloom.operators.moments import gram

    sums = gram(df, columns)[1:, 1:]
    cells = [(i + 1, j + 1, float(sums[i, j])) for i in range(len(columns)) for j in range(len(columns))]
    return small_frame(df.sparkSession, cells, "i int, j int, v double")
