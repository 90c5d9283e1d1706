"""Silhouette averages: exact over all pairs, or linear on squared distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import scores
from statloom.functions.scores import linear, squared_distances, total
from statloom.session import Tables, bounded_rows, literal_sql

BLOCK_ROWS = 2048
#: Different points, in at most FAR_FEATURES dimensions, from which far cells are summed by interpolation.
FAR_ROWS, FAR_FEATURES = 50_000, 2
#: Nodes a dimension, the gap in half widths beyond which cells are far (error about 8 ** -NODES), and numbers held for all cells at most.
NODES, GAP, FAR_NUMBERS = 12, 4.0, 8_000_000
#: Bits of a cell's place in each dimension.
BITS = 24
#: Blocks of a group at most; a task holds those of two groups.
BLOCKS_PER_GROUP = 16
MAX_CLUSTERS = 10_000


def euclidean_silhouette(
    points: DataFrame, features: list[str], cluster: str, block_rows: int = BLOCK_ROWS, far_rows: int = FAR_ROWS
) -> float | None:
    """Average of (b - a) / max(a, b) with Euclidean distances over all pairs.

    From `far_rows` different points in one or two dimensions on, see `_by_cells`; otherwise pair by pair:

    copies of a point are counted once with their weight. The different points
    are dealt into blocks of bounded size by hash, and blocks into groups; a task takes the
    blocks of two groups and returns distance sums per point and cluster, so what is moved
    grows with the points times the square root of the tasks. Pairs of points are never rows. A point alone in its cluster, or 0/0, has
    no silhouette and drops out.
    """
    weighted = points.groupBy(*features, cluster).agg(F.count("*").alias("w"))
    by_cluster = weighted.groupBy(cluster).agg(F.sum("w").alias("n"), F.count("*").alias("m"))
    sizes = bounded_rows(by_cluster, MAX_CLUSTERS, "clusters")
    if len(sizes) < 2:
        return None
    labels = sorted(r[cluster] for r in sizes)
    count = {r[cluster]: r["n"] for r in sizes}
    m = sum(r["m"] for r in sizes)
    blocks = max(1, -(-m // block_rows))

    spark = points.sparkSession
    d = len(features)
    # As many cells as make the work of near pairs about that of far cells, 25 cells being near.
    cells_wanted = math.ceil((25 * m * m / NODES ** (2 * d)) ** (1 / 3))
    cells_wanted = min(cells_wanted, FAR_NUMBERS // (4 * len(sizes) * NODES**d))
    if d <= FAR_FEATURES and m >= far_rows and cells_wanted > 8:
        ends = weighted.agg(*[g(F.col(f).cast("double")) for g in (F.min, F.max, F.count) for f in features]).first()
        # Missing or endless values lie in no cell.
        if min(ends[2 * d :]) == m and np.isfinite(ends[: 2 * d]).all():
            return _by_cells(weighted, features, cluster, count, np.array(ends[: 2 * d]).reshape(2, d), max(1, 2 * m // cells_wanted))
    # Blocks are dealt to groups; a task takes one pair of groups, so a block is shipped as often as there are groups.
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-blocks // BLOCKS_PER_GROUP), min(blocks, math.ceil(math.sqrt(2 * wanted))))
    cells = [f"v{i}" for i in range(d)] + ["c", "w"]
    own_place = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(cluster)).cast("int") - 1
    cell = F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(features)], own_place.alias("c"), F.col("w").cast("double").alias("w"))
    packed = (
        weighted.select(F.pmod(F.xxhash64(*features, cluster), F.lit(blocks)).alias("block"), cell.alias("p"))
        .groupBy("block")
        .agg(F.collect_list("p").alias("p"))
        .select("block", F.pmod("block", F.lit(groups)).cast("int").alias("own"), *[F.col("p")[c].alias(c) for c in cells])
    )
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    k = len(labels)

    def weights(c, w):
        to = np.zeros((len(c), k))
        to[np.arange(len(c)), c.astype(int)] = w
        return to

    def sums(pair: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for row in pair.to_dict("records"):
            x = np.column_stack([row[f"v{i}"] for i in range(d)])
            held[row["block"]] = (row["own"], x, np.asarray(row["c"]), np.asarray(row["w"]), np.zeros((len(x), k)))
        low, high, order = pair["low"].iloc[0], pair["high"].iloc[0], sorted(held)
        for n, a in enumerate(order):
            for b in order[n:]:
                if {held[a][0], held[b][0]} != {low, high}:
                    continue
                (_, xa, ca, wa, sa), (_, xb, cb, wb, sb) = held[a], held[b]
                square = np.zeros((len(xa), len(xb)))
                for l in range(d):
                    diff = xa[:, l, None] - xb[None, :, l]
                    square += diff * diff
                dist = np.sqrt(square, out=square)
                sa += dist @ weights(cb, wb)
                if a != b:
                    sb += dist.T @ weights(ca, wa)
        return pd.concat([_sum_frame(x, c, w, s) for _, x, c, w, s in held.values()])

    per_block = met.groupBy("low", "high").applyInPandas(sums, "x array<double>, own int, w double, sums array<double>")
    per_point = per_block.groupBy("x", "own", "w").agg(
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(labels))]
    )
    return _weighted_average(_scored(per_point, [count[c] for c in labels]))


def _scored(per_point: DataFrame, totals: list[int]) -> DataFrame:
    """(w, a, b) of points with their `own` cluster's place and the sums s0, s1, ... of distances to all clusters."""
    own_sum = F.get(F.array(*[f"s{i}" for i in range(len(totals))]), F.col("own"))
    own_size = F.get(F.array(*[F.lit(float(n)) for n in totals]), F.col("own"))
    others = [F.when(F.col("own") != i, F.col(f"s{i}") / F.lit(float(n))) for i, n in enumerate(totals)]
    return per_point.select(
        "w",
        F.try_divide(own_sum, own_size - 1).alias("a"),
        (F.least(*others) if len(others) > 1 else others[0]).alias("b"),
    )


def _by_cells(weighted: DataFrame, features: list[str], cluster: str, count: dict, range_: np.ndarray, most: int) -> float | None:
    """The same average where points lie in cells of a tree that halves every dimension.

    Distances between near cells are summed pair by pair. Where the gap of two cells is wide the distance
    is smooth, so it is interpolated from Chebyshev nodes of both cells to about the rounding of
    a double: a cell's points and weights count at its nodes, and sums at nodes give those at points. Every point
    counts; none is left out or drawn. A task takes neighbouring cells and the points of cells near to them.
    """
    spark, d, labels = weighted.sparkSession, len(features), sorted(count)
    k, names = len(labels), [f"v{i}" for i in range(d)]
    own = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col(cluster)).cast("int") - 1
    store = Tables(spark)
    rows = store.settle(weighted.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)], own.alias("c"), F.col("w").cast("double").alias("w")))
    low, extent = range_[0], float((range_[1] - range_[0]).max())
    celled = _dealt(rows, names, low, extent, most)
    box = [F.min(n) for n in names] + [F.max(n) for n in names]
    packed = store.settle(
        celled.groupBy("cell").agg(F.collect_list(F.struct(*names, "c", "w")).alias("p"), F.array(*box).alias("box")).select("cell", "box", *[F.col("p")[x].alias(x) for x in (*names, "c", "w")])
    )
    boxes = {r["cell"]: r["box"] for r in bounded_rows(packed.select("cell", "box"), FAR_NUMBERS, "cells")}
    order = sorted(boxes)
    place = {cell: i for i, cell in enumerate(order)}
    ends = np.array([boxes[c] for c in order])
    half = (ends[:, d:] - ends[:, :d]) / 2
    # Flat cells get some width, so that their nodes differ.
    middle, half = (ends[:, d:] + ends[:, :d]) / 2, np.maximum(half, np.maximum(1e-3 * half.max(axis=1, keepdims=True), 1e-9 * extent))

    def is_near(i: int) -> np.ndarray:
        gap = np.maximum(np.abs(middle - middle[i]) - half - half[i], 0.0)
        return np.sqrt((gap * gap).sum(axis=1)) < GAP * np.maximum(half.max(axis=1), half[i].max())

    def columns(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.column_stack([row[n] for n in names]), np.asarray(row["c"]).astype(int), np.asarray(row["w"], dtype=float)

    def at_nodes(batches):
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                x, c, w = columns(row)
                i = place[row["cell"]]
                found.append((_interpolation((x - middle[i]) / half[i]).T @ _weights(c, w, k)).ravel())
            yield pd.DataFrame({"cell": batch["cell"], "v": found})

    moments = np.zeros((len(order), NODES**d, k))
    for r in packed.select("cell", *names, "c", "w").mapInPandas(at_nodes, "cell long, v array<double>").collect():
        moments[place[r["cell"]]] = np.reshape(r["v"], (-1, k))
    unit = np.stack(np.meshgrid(*[_nodes()] * d, indexing="ij"), axis=-1).reshape(-1, d)

    tile = max(1, len(order) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = {(int(j), i // tile) for i in range(len(order)) for j in np.flatnonzero(is_near(i))}
    pairs = spark.createDataFrame(pd.DataFrame([(order[j], t) for j, t in sorted(met)], columns=["cell", "tile"]))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        held = {place[row["cell"]]: columns(row) for row in group.to_dict("records")}
        out = []
        for i in sorted(held):
            if i // tile != group["tile"].iloc[0]:
                continue
            x, c, w = held[i]
            near = is_near(i)
            beside = [held[j] for j in np.flatnonzero(near)]
            total_ = _distance_sums(x, np.concatenate([b[0] for b in beside]), np.concatenate([_weights(b[1], b[2], k) for b in beside]))
            nodes, far = middle[i] + half[i] * unit, np.flatnonzero(~near)
            at = np.zeros((len(unit), k))
            for part in np.array_split(far, max(1, len(far) // 16)):
                at += _distance_sums(nodes, (middle[part, None] + half[part, None] * unit).reshape(-1, d), moments[part].reshape(-1, k))
            out.append(pd.DataFrame({"own": c, "w": w, "sums": list(total_ + _interpolation((x - middle[i]) / half[i]) @ at)}))
        return pd.concat(out)

    summed = packed.drop("box").join(F.broadcast(pairs), "cell").groupBy("tile").applyInPandas(sums, "own int, w double, sums array<double>")
    scored = _scored(summed.select("own", "w", *[F.col("sums")[i].alias(f"s{i}") for i in range(k)]), [count[c] for c in labels])
    value = _weighted_average(scored)
    store.clear()
    return value


def _dealt(rows: DataFrame, names: list[str], low: np.ndarray, extent: float, most: int) -> DataFrame:
    """`rows` with their cell: cells of more than `most` points are halved in every dimension, level by level."""
    d = len(names)

    def celled(starts: np.ndarray) -> DataFrame:
        def deal(batches):
            for batch in batches:
                at = (batch[names].to_numpy(dtype=float) - low) / (extent or 1.0) * (1 << BITS)
                at = np.clip(at, 0, (1 << BITS) - 1).astype(np.int64)
                code = np.zeros(len(at), np.int64)
                for b in range(BITS):
                    for i in range(d):
                        code |= ((at[:, i] >> b) & 1) << (b * d + i)
                yield batch.assign(cell=np.searchsorted(starts, code, side="right") - 1)

        return rows.mapInPandas(deal, ", ".join(f"{n} double" for n in names) + ", c int, w double, cell long")

    spans = np.full(1 << (3 * d), 1 << ((BITS - 3) * d), np.int64)
    while True:
        starts = np.cumsum(spans) - spans
        frame = celled(starts)
        large = np.zeros(len(spans), bool)
        large[[r["cell"] for r in frame.groupBy("cell").count().where(F.col("count") > most).collect()]] = True
        large &= spans > 1
        if not large.any():
            return frame
        parts = np.where(large, 1 << d, 1)
        spans = np.repeat(spans // parts, parts)


def _nodes() -> np.ndarray:
    return np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _interpolation(t: np.ndarray) -> np.ndarray:
    """Weights of the product of Chebyshev nodes at points of [-1, 1] ** d, one row a point."""
    degree = np.arange(1, NODES)
    base = np.cos(degree[:, None] * np.arccos(_nodes()))
    out = np.ones((len(t), 1))
    for x in t.T:
        own = (1 + 2 * np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * degree) @ base) / NODES
        out = (out[:, :, None] * own[:, None, :]).reshape(len(t), -1)
    return out


def _weights(c: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    to = np.zeros((len(c), k))
    to[np.arange(len(c)), c] = w
    return to


def _distance_sums(x: np.ndarray, y: np.ndarray, to: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """For each x the sums of distances to all y, weighted by the columns of `to`, in pieces that fit the cache."""
    out = np.zeros((len(x), to.shape[1]))
    step = 1024
    for j in range(0, len(y), step):
        part, beside = y[j : j + step], to[j : j + step]
        for i in range(0, len(x), piece // step):
            own = x[i : i + piece // step]
            square = own[:, 0, None] - part[None, :, 0]
            square *= square
            for l in range(1, x.shape[1]):
                diff = own[:, l, None] - part[None, :, l]
                diff *= diff
                square += diff
            out[i : i + piece // step] += np.sqrt(square, out=square) @ beside
    return out


def _sum_frame(x: np.ndarray, own: np.ndarray, w: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"x": list(x), "own": own, "w": w, "sums": list(sums)})


def squared_silhouette(points: DataFrame, features: list[str], cluster: str) -> float | None:
    """The same average with squared distances, from per-cluster counts and sums.

    The mean squared distance from x to a cluster is |x|² - 2x·mean + mean(|x|²),
    so one aggregate and one projection are enough.
    """
    middle = points.agg(*[F.avg(c).alias(c) for c in features]).first()
    if middle[0] is None:
        return None
    centred = points.select(
        F.col(cluster).alias("own"), *[(F.col(c) - F.lit(middle[c])).alias(f"v{i}") for i, c in enumerate(features)]
    )
    values = [f"v{i}" for i in range(len(features))]
    normed = centred.selectExpr("*", total([f"{v} * {v}" for v in values]) + " AS q")
    sums = normed.groupBy("own").agg(F.count("*").alias("n"), F.sum("q").alias("q"), *[F.expr(f"sum({v}) AS {v}") for v in values])
    groups = bounded_rows(sums, MAX_CLUSTERS, "clusters")
    if len(groups) < 2:
        return None
    if len(groups) * len(features) > scores.EXPRESSION_TERMS:
        return _squared_by_batch(centred, values, groups)
    measured = normed.select(
        "own",
        *[
            (F.expr(f"{literal_sql(g['n'])} * q") - linear(values, [2.0 * g[v] for v in values], -g["q"])).alias(f"d{c}")
            for c, g in enumerate(groups)
        ],
    )
    inside = [f"own = {g['own']!r}" for g in groups]
    a = [f"WHEN {test} THEN try_divide(d{c}, {literal_sql(g['n'] - 1)})" for c, (test, g) in enumerate(zip(inside, groups))]
    b = [f"IF({test}, NULL, d{c} / {literal_sql(g['n'])})" for c, (test, g) in enumerate(zip(inside, groups))]
    scored = measured.selectExpr("1D AS w", f"CASE {' '.join(a)} END AS a", f"least({', '.join(b)}) AS b")
    return _weighted_average(scored)


def _squared_by_batch(centred: DataFrame, values: list[str], groups: list) -> float | None:
    """The same per Arrow batch: |x - mean|² plus the cluster's own spread."""
    place = {g["own"]: c for c, g in enumerate(groups)}
    n = np.array([g["n"] for g in groups], dtype=float)
    means = np.array([[g[v] for v in values] for g in groups]) / n[:, None]
    spread = np.array([g["q"] for g in groups]) / n - (means * means).sum(axis=1)

    def partial(batches):
        summed, counted = 0.0, 0
        for batch in batches:
            own = batch["own"].map(place).to_numpy()
            mean_distance = squared_distances(batch[values].to_numpy(dtype=float), means) + spread
            at = (np.arange(len(own)), own)
            alone = n[own] == 1
            a = mean_distance[at] * n[own] / np.where(alone, 1.0, n[own] - 1)
            mean_distance[at] = np.inf
            b = mean_distance.min(axis=1)
            greater = np.maximum(a, b)
            used = ~alone & (greater > 0)
            summed += ((b - a)[used] / greater[used]).sum()
            counted += int(used.sum())
        yield pd.DataFrame({"s": [summed], "n": [counted]})

    rows = centred.mapInPandas(partial, "s double, n long")
    return rows.selectExpr("try_divide(sum(s), sum(n)) AS s").first()["s"]


def _weighted_average(scored: DataFrame) -> float | None:
    """Average silhouette of (w, a, b) rows; a row without one counts for nothing."""
    value = "IF(a IS NULL, NULL, try_divide(b - a, greatest(a, b)))"
    valued = scored.selectExpr("w", f"{value} AS s")
    return valued.selectExpr("try_divide(sum(w * s), sum(IF(s IS NULL, NULL, w))) AS s").first()["s"]
