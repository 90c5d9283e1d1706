"""Exact ranks and equal-frequency buckets without a single-task sort.

The values of a feature are cut into chunks by approximate quantiles. Counts
per chunk give the rank at which each chunk starts, so a rank inside a chunk
is local work. For bucket edges only the few chunks that hold an edge are
looked at value by value; all others are settled by their counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import number, quoted, small_frame, unused_names

SINGLE_CHUNK_ROWS = 2_000_000
#: Chunks of a column at most; beyond this many times SINGLE_CHUNK_ROWS rows chunks grow instead, and their tasks spill.
MAX_CHUNKS = 10_000
#: Tasks that merge sketches before the last one does.
SKETCH_GROUPS = 64


@dataclass(frozen=True)
class Bucket:
    """One bucket of a feature: number, least and greatest value, row count."""

    xq: int
    mn: float
    mx: float
    n: int


def chunk_count(rows: int, chunk_rows: int = SINGLE_CHUNK_ROWS) -> int:
    """How many chunks keep a chunk near `chunk_rows` rows."""
    return max(1, min(MAX_CHUNKS, -(-rows // chunk_rows)))


def cut_points(df: DataFrame, columns: list[str], chunks: int) -> dict[str, list[float]]:
    """Approximate quantiles of every column, from sketches that are merged in two levels.

    Each task sketches its rows, SKETCH_GROUPS tasks merge those of their share, and one
    merges what these give, so no task reads all sketches. Chunks need not be equal: what
    is computed from them is exact wherever their borders lie.
    """
    if chunks <= 1:
        return {c: [] for c in columns}
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    size = F.lit(min(65_535, max(4_000, 8 * chunks)))
    names = [f"c{i}" for i in range(len(columns))]
    share = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("share")
    values = df.select(share, *[number(c).alias(n) for c, n in zip(columns, names)])
    partial = values.groupBy("share").agg(*[F.kll_sketch_agg_double(n, size).alias(n) for n in names])
    whole = partial.agg(*[F.kll_merge_agg_double(n, size).alias(n) for n in names])
    read = [F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, shares)).alias(n) for n in names]
    row = whole.select(*read).first()
    return {c: sorted(set(row[n] or [])) for c, n in zip(columns, names)}


def bucket_index(df: DataFrame, cuts: dict[str, list[float]], out: dict[str, str]) -> DataFrame:
    """Add, per column, how many of its cut points are <= the value (NULL for NULL)."""
    searched = [c for c in cuts if cuts[c]]
    kept = [quoted(c) for c in df.columns]
    if searched:
        names = unused_names(df, [f"_{kind}_{i}" for kind in ("value", "index") for i in range(len(searched))])
        source, target = dict(zip(searched, names)), dict(zip(searched, names[len(searched) :]))
        df = df.select("*", *[number(c).alias(source[c]) for c in searched])
        df = Bucketizer(
            inputCols=[source[c] for c in searched],
            outputCols=[target[c] for c in searched],
            splitsArray=[[float("-inf"), *cuts[c], float("inf")] for c in searched],
            handleInvalid="keep",
        ).transform(df)
    columns = [
        F.when(number(c).isNotNull(), F.col(target[c]).cast("int") if cuts[c] else F.lit(0)).alias(out[c])
        for c in cuts
    ]
    return df.select(*kept, *columns)


def running_sums(
    df: DataFrame, keys: list[str], order: str, values: list[str], chunk: str | None = None
) -> DataFrame:
    """Add `cum_<v>` (running sum up to and with this row, by `order`) and `tot_<v>`.

    With a `chunk` column (monotone in `order`) the sum is taken inside each
    chunk and moved by the total of earlier chunks, so one key may hold any
    number of rows without filling one task.
    """
    if chunk is None:
        inside = f"PARTITION BY {', '.join(keys)}" if keys else ""
        return df.selectExpr(
            "*",
            *[f"sum({v}) OVER ({inside} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum_{v}" for v in values],
            *[f"sum({v}) OVER ({inside}) AS tot_{v}" for v in values],
        )
    group = [*keys, chunk]
    sums = df.groupBy(*group).agg(*[F.sum(v).alias(v) for v in values])
    inside = f"PARTITION BY {', '.join(keys)}" if keys else ""
    starts = sums.selectExpr(
        *group,
        *[
            f"coalesce(sum({v}) OVER ({inside} ORDER BY {chunk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off_{v}"
            for v in values
        ],
        *[f"sum({v}) OVER ({inside}) AS tot_{v}" for v in values],
    )
    local = f"PARTITION BY {', '.join(group)} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    return df.join(starts, group).selectExpr(
        *df.columns,
        *[f"off_{v} + sum({v}) OVER ({local}) AS cum_{v}" for v in values],
        *[f"tot_{v}" for v in values],
    )


def value_ranks(df: DataFrame, column: str, chunk_rows: int = SINGLE_CHUNK_ROWS) -> DataFrame:
    """Distinct values of `column` with `n` copies and their `rank` among all rows."""
    present = df.select(number(column).alias("x")).where("x IS NOT NULL")
    cuts = cut_points(present, ["x"], chunk_count(present.count(), chunk_rows))
    counted = bucket_index(present, cuts, {"x": "_chunk"}).groupBy("_chunk", "x").agg(F.count("*").alias("n"))
    summed = running_sums(counted, [], "x", ["n"], "_chunk")
    return summed.select("x", "n", (F.col("cum_n") - F.col("n") + 1).alias("rank"))


def bucket_of_rank(rank: int, bins: int, rows: int) -> int:
    """ceil(bins * rank / rows) in whole numbers."""
    return (bins * rank + rows - 1) // rows


def long_form(df: DataFrame, columns: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """(f, x[, chunk]) rows of numeric columns; `f` is the position in `columns`."""
    parts = [
        F.struct(
            F.lit(i).alias("f"),
            number(c).alias("x"),
            *([F.col(extra[c]).alias("chunk")] if extra else []),
        )
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*parts))).where("x IS NOT NULL")


def equal_frequency_buckets(
    df: DataFrame, columns: list[str], bins: int, chunk_rows: int = SINGLE_CHUNK_ROWS
) -> dict[str, list[Bucket]]:
    """Exact edges of `bins` equal-frequency buckets; at most `bins` per column.

    Equal values share a bucket, so bucket numbers can be skipped.
    """
    if not columns:
        return {}
    if bins < 1:
        raise ValueError("bins must be at least 1")
    counts = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    rows = [counts[f"n{i}"] for i in range(len(columns))]
    if not max(rows):
        return {c: [] for c in columns}

    chunks = chunk_count(max(rows), chunk_rows)
    if chunks > 1:
        chunks = min(MAX_CHUNKS, max(chunks, 8 * bins))
    cuts = cut_points(df, columns, chunks)
    names = {c: f"_chunk_{i}" for i, c in enumerate(columns)}
    spread = long_form(bucket_index(df, cuts, names), columns, names)

    settled: list[tuple[int, Bucket]] = []
    if chunks == 1:
        open_chunks = [(i, 0, 0, rows[i]) for i in range(len(columns)) if rows[i]]
    else:
        open_chunks = []
        summary = spread.groupBy("f", "chunk").agg(
            F.count("*").alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")
        )
        by_feature: dict[int, list] = {}
        for r in summary.collect():
            by_feature.setdefault(r.f, []).append(r)
        for f, group in by_feature.items():
            group.sort(key=lambda r: r.chunk)
            starts = [0, *accumulate(r.n for r in group)]
            for r, start in zip(group, starts):
                first = bucket_of_rank(start + 1, bins, rows[f])
                last = bucket_of_rank(start + r.n, bins, rows[f])
                if first == last or r.mn == r.mx:
                    settled.append((f, Bucket(first, r.mn, r.mx, r.n)))
                else:
                    open_chunks.append((f, r.chunk, start, rows[f]))

    if open_chunks:
        table = small_frame(df.sparkSession, open_chunks, "f int, chunk int, start long, total long")
        kept = spread if chunks == 1 else spread.join(F.broadcast(table), ["f", "chunk"], "left_semi")
        counted = kept.groupBy("f", "chunk", "x").agg(F.count("*").alias("n")).join(F.broadcast(table), ["f", "chunk"])
        before = Window.partitionBy("f", "chunk").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        rank = F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)) + 1
        edges = (
            counted.select("f", "x", "n", _whole_bucket(rank, bins).alias("xq"))
            .groupBy("f", "xq")
            .agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.sum("n").alias("n"))
        )
        settled += [(r.f, Bucket(r.xq, r.mn, r.mx, r.n)) for r in edges.collect()]

    result: dict[str, list[Bucket]] = {}
    for i, c in enumerate(columns):
        merged: dict[int, Bucket] = {}
        for f, b in settled:
            if f == i:
                old = merged.get(b.xq, Bucket(b.xq, b.mn, b.mx, 0))
                merged[b.xq] = Bucket(b.xq, min(old.mn, b.mn), max(old.mx, b.mx), old.n + b.n)
        result[c] = [merged[q] for q in sorted(merged)]
    return result


def _whole_bucket(rank: Column, bins: int) -> Column:
    shifted = rank * F.lit(bins).cast("long") + F.col("total") - 1
    return F.call_function("div", shifted, F.col("total")).cast("int")


def quantise(df: DataFrame, buckets: dict[str, list[Bucket]], out: dict[str, str]) -> DataFrame:
    """Add each column's bucket number.

    A value belongs to the bucket with the greatest lower edge not above it;
    values below every edge fall into the first bucket.
    """
    index = {c: f"_bucket_{i}" for i, c in enumerate(buckets)}
    df = bucket_index(df, {c: [b.mn for b in buckets[c][1:]] for c in buckets}, index)
    numbers = [
        F.get(F.array(*[F.lit(b.xq) for b in buckets[c]]), F.col(index[c])).alias(out[c])
        if buckets[c]
        else F.lit(None).cast("int").alias(out[c])
        for c in buckets
    ]
    kept = [quoted(c) for c in df.columns if c not in index.values()]
    return df.select(*kept, *numbers)


def equal_width_bucket(column: str, low: float, high: float, bins: int) -> Column:
    """Bucket 1..bins of equal width over [low, high]; values outside go to the end buckets."""
    x = number(column)
    if not high > low:
        return F.when(x.isNotNull(), F.lit(1))
    inside = F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return F.least(F.greatest(inside, F.lit(1)), F.lit(bins)).cast("int")


def equal_width(df: DataFrame, columns: list[str], bins: int, out: dict[str, str]) -> DataFrame:
    """Equal-width buckets between each column's least and greatest value."""
    ends = df.agg(
        *[F.min(number(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(number(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    added = []
    for i, c in enumerate(columns):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        bucket = F.lit(None).cast("int") if low is None else equal_width_bucket(c, low, high, bins)
        added.append(bucket.alias(out[c]))
    return df.select("*", *added)


def equal_width_buckets(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[Bucket]]:
    """Buckets of equal width between each column's least and greatest value, by the values they hold; empty ones are left out."""
    index = {c: f"_width_{i}" for i, c in enumerate(columns)}
    index = dict(zip(columns, unused_names(df, list(index.values()))))
    placed = equal_width(df, columns, bins, index)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(index[c]).alias("xq"), number(c).alias("x")) for i, c in enumerate(columns)]))
    held = placed.select(each).where("xq IS NOT NULL").groupBy("f", "xq").agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count("*").alias("n"))
    found: dict[str, list[Bucket]] = {c: [] for c in columns}
    # At most `bins` rows a column.
    for r in sorted(held.collect()) if columns else []:
        found[columns[r.f]].append(Bucket(r.xq, r.mn, r.mx, r.n))
    return found
