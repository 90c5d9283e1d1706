"""Gaussian classes whose parameters are a table, for any number of classes.

The fit is one grouped aggregate and a map over its rows; nothing of a class reaches the
driver. Prediction is exact, but compares a row only with the classes that may be its best. Rows are dealt
to cells of near rows. For the box around a cell's rows each class has a least and a greatest score; classes
whose greatest one is below the least one of another class are best for no row of that cell. Blocks of classes
meet groups of boxes twice, once for the least score to reach and once for the classes that reach it; rows
then meet what is left, in blocks of bounded size on both sides, each pair one computation in a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import session
from statloom.operators.encode import number_rows
from statloom.operators.joins import lookup_join
from statloom.operators.quantile import bucket_index, cut_points
from statloom.plans.gaussian import PREDICTION, PROBABILITY, SMOOTHING, regular

#: Rows of a block, and numbers of the classes' parameters that a block holds.
ROW_BLOCK, CLASS_NUMBERS = 4096, 200_000
#: Pairs of blocks that a task takes in large tables, boxes of a group, and features that cells are cut by.
PAIRS_PER_TASK, BOXES, CELL_FEATURES = 16, 1024, 3
#: Scores that a task computes at a time, and features up to which pairs of them are taken one by one.
SCORES, PAIRED_FEATURES = 1 << 17, 8


@dataclass
class GaussianTable:
    """`classes`: (label, n, prior, mean, covariance, precision, const, ridge), matrices row by row."""

    x_columns: list[str]
    y_column: str
    multivariate: bool
    classes: DataFrame

    def transform(self, df: DataFrame, output: str = PREDICTION, probability: str = PROBABILITY) -> DataFrame:
        """Add the class of the greatest prior * density (ties: the first class) and that product; NULL where a feature is missing."""
        d, spark = len(self.x_columns), df.sparkSession
        tables = session.Tables(spark)
        rid, best = session.unused_names(df, ["_row", "_best"])
        features = [session.number(c) for c in self.x_columns]
        # Written once, so that the numbers of its rows stay the same.
        kept = tables.settle(df.drop(output, probability).withColumn(rid, F.monotonically_increasing_id()))
        per_block = max(1, CLASS_NUMBERS // (d * d + d + 1))
        classes = tables.settle(number_rows(self.classes.select("label", "const", "mean", "precision"), ["label"], "place"))
        class_blocks = max(1, -(-classes.count() // per_block))
        known = kept.where(session.known(features)).select(F.col(rid).alias("r"), F.array(*features).alias("x"))
        row_blocks = max(1, -(-known.count() // ROW_BLOCK))
        rows = _celled(known, d, row_blocks)
        boxes = rows.groupBy("cell").agg(
            F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("low"),
            F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("high"),
            F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("parts"),
        )
        boxes = tables.settle(boxes)
        held = classes.groupBy(F.pmod(F.xxhash64("place"), F.lit(class_blocks)).cast("int").alias("b"))
        held = tables.settle(held.agg(F.collect_list(F.struct("place", "const", "mean", "precision")).alias("c")))
        held = held.select("b", F.col("c.place").alias("place"), F.col("c.const").alias("const"), F.flatten("c.mean").alias("mean"), F.flatten("c.precision").alias("precision"))

        def least(batches):
            for low, high, row in _each(batches, d):
                worst, _ = score_bounds(low, high, *_parameters(row, d))
                yield pd.DataFrame({"cell": row["cell"], "floor": worst.max(axis=1)})

        def reaching(batches):
            for low, high, row in _each(batches, d):
                mean, precision, const = _parameters(row, d)
                _, best = score_bounds(low, high, mean, precision, const)
                # Not below, so that what is no number stays.
                stays = ~(best < np.asarray(row["floor"])[:, None])
                found = [np.flatnonzero(s) for s in stays]
                wanted = [(c, f) for c, f in zip(row["cell"], found) if len(f)]
                place = np.asarray(row["place"])
                yield pd.DataFrame(
                    [(c, len(f), place[f], const[f], mean[f].ravel(), precision[f].ravel()) for c, f in wanted],
                    columns=["cell", "n", "place", "const", "mean", "precision"],
                )

        met = _meeting(boxes.select("cell", "low", "high"), held, class_blocks, ["cell", "low", "high"])
        floors = met.mapInPandas(least, "cell long, floor double").groupBy("cell").agg(F.max("floor").alias("floor"))
        floored = tables.settle(boxes.join(floors, "cell"))
        met = _meeting(floored.select("cell", "low", "high", "floor"), held, class_blocks, ["cell", "low", "high", "floor"])
        left = "cell long, n long, place array<long>, const array<double>, mean array<double>, precision array<double>"
        left = tables.settle(met.mapInPandas(reaching, left))
        # What is left for a cell is dealt into chunks of about a block of classes; each meets all parts of its rows.
        sizes = left.groupBy("cell").agg(F.ceil(F.sum("n") / per_block).cast("int").alias("chunks")).join(boxes.select("cell", "parts"), "cell")
        chunk = F.pmod(F.xxhash64(F.get("place", F.lit(0))), F.col("chunks"))
        names = ["place", "const", "mean", "precision"]
        chunked = left.join(sizes, "cell").groupBy("cell", "parts", chunk.alias("chunk")).agg(F.collect_list(F.struct(*names)).alias("c"))
        spread = chunked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.flatten(F.col("c")[n]).alias(n) for n in names])
        pairs = sizes.agg(F.sum(F.col("chunks") * F.col("parts").cast("long"))).first()[0] or 0

        # A block of rows is much work in few bytes, so tasks are counted, not sized.
        wanted = max(-(-pairs // PAIRS_PER_TASK), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        tasks = min(row_blocks, wanted)
        dealt = lookup_join(rows, boxes.select("cell", "parts"), ["cell"]).withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int"))
        packed = dealt.select("cell", "part", "r", "x").repartition(tasks, "cell", "part").groupBy("cell", "part").agg(F.collect_list(F.struct("r", "x")).alias("rows"))
        met = packed.join(spread, ["cell", "part"]).select(F.col("rows.r").alias("r"), F.flatten("rows.x").alias("x"), *names)
        if pairs > PAIRS_PER_TASK * tasks:
            met = met.repartition(wanted)

        def score(batches):
            for row in _rows(batches):
                mean, precision, const = _parameters(row, d)
                place, order = np.asarray(row["place"]), np.argsort(row["place"])
                own, value = best_of(np.asarray(row["x"]).reshape(-1, d), mean[order], precision[order], const[order])
                yield pd.DataFrame({"r": row["r"], "place": place[order][own], "score": value})

        found = met.mapInPandas(score, "r long, place long, score double")
        first = found.groupBy("r").agg(F.min_by(F.struct("place", "score"), F.struct(-F.col("score"), F.col("place"))).alias("s")).select("r", "s.*")
        # Written, as the join reads its rows more than once where classes are many.
        first = lookup_join(tables.settle(first), classes.select("place", "label"), ["place"]).select(F.col("r").alias(rid), F.struct("label", "score").alias(best))
        joined = kept.join(first, rid, "left")
        columns = [F.col(session.quoted(c)) for c in df.columns if c not in (output, probability)]
        return joined.select(*columns, F.col(best)["label"].alias(output), F.exp(F.col(best)["score"]).alias(probability))


def _celled(known: DataFrame, d: int, row_blocks: int) -> DataFrame:
    """Rows with `cell`, a grid by approximate quantiles of about as many cells as there are blocks of rows."""
    axes = min(d, CELL_FEATURES)
    cuts = math.ceil(row_blocks ** (1 / axes))
    names = [f"x{i}" for i in range(axes)]
    index = {n: f"i{i}" for i, n in enumerate(names)}
    wide = known.select("r", "x", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    placed = bucket_index(wide, cut_points(wide, names, cuts), index)
    cell = F.lit(0).cast("long")
    for n in names:
        cell = cell * F.lit(cuts + 1) + F.col(index[n])
    return placed.select("r", "x", cell.alias("cell"))


def _meeting(boxes: DataFrame, held: DataFrame, class_blocks: int, names: list[str]) -> DataFrame:
    """Groups of boxes with each block of classes."""
    groups = max(1, -(-boxes.count() // BOXES))
    grouped = boxes.groupBy(F.pmod(F.xxhash64("cell"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct(*names)).alias("box"))
    grouped = grouped.select(*[(F.flatten(F.col("box")[n]) if n in ("low", "high") else F.col("box")[n]).alias(n) for n in names])
    met = grouped.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(class_blocks - 1)))).join(held, "b")
    return met.repartition(groups * class_blocks)


def _rows(batches):
    """One row after the other, each a block."""
    for batch in batches:
        for i in range(len(batch)):
            yield {c: batch[c].iloc[i] for c in batch.columns}


def _each(batches, d: int):
    """(least corners, greatest corners, row), some boxes at a time."""
    for row in _rows(batches):
        low, high = (np.asarray(row[n]).reshape(-1, d) for n in ("low", "high"))
        step = max(1, SCORES // max(1, len(row["const"])))
        for i in range(0, len(low), step):
            own = {n: row[n][i : i + step] for n in ("cell", "floor") if n in row}
            yield low[i : i + step], high[i : i + step], {**row, **own}


def _parameters(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(row["mean"]).reshape(-1, d), np.asarray(row["precision"]).reshape(-1, d, d), np.asarray(row["const"])


def score_bounds(low: np.ndarray, high: np.ndarray, mean: np.ndarray, precision: np.ndarray, const: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each box and class: no row of the box scores less than the first, none more than the second, roundings included."""
    d = mean.shape[1]
    with np.errstate(all="ignore"):
        half, middle = (high - low) / 2, low / 2 + high / 2
        gaps = [np.abs(middle[:, i, None] - mean[None, :, i]) for i in range(d)]
        if not (precision * (1 - np.eye(d))).any():
            near, far = np.zeros(gaps[0].shape), np.zeros(gaps[0].shape)
            for i in range(d):
                near += precision[None, :, i, i] * np.maximum(gaps[i] - half[:, i, None], 0) ** 2
                far += precision[None, :, i, i] * (gaps[i] + half[:, i, None]) ** 2
            size = far
        else:
            gap = middle[:, None, :] - mean[None, :, :]
            square = np.einsum("nci,cij,ncj->nc", gap, precision, gap, optimize=True)
            root = np.sqrt(np.maximum(square, 0))
            # The longest way from the middle to a corner, in the metric of the class.
            reach = half @ np.sqrt(np.maximum(np.diagonal(precision, axis1=1, axis2=2), 0)).T
            near, far = np.maximum(root - reach, 0) ** 2, (root + reach) ** 2
            wide = np.abs(gap) + half[:, None, :]
            size = np.einsum("nci,cij,ncj->nc", wide, np.abs(precision), wide, optimize=True)
        room = 1e-6 + 1e-9 * (np.abs(const)[None] + size)
        worst, best = const[None] - 0.5 * far - room, const[None] - 0.5 * near + room
    # What is no number bounds nothing.
    return np.where(np.isnan(worst), -np.inf, worst), np.where(np.isnan(best), np.inf, best)


def best_of(x: np.ndarray, mean: np.ndarray, precision: np.ndarray, const: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the class of the greatest log score, the first on a tie, and that score."""
    place, value = np.zeros(len(x), np.int32), np.full(len(x), -np.inf)
    d, every = x.shape[1], np.arange(len(x))
    diagonal = not (precision * (1 - np.eye(d))).any()
    step = max(1, SCORES // max(1, len(x)))
    for c in range(0, len(mean), step):
        part = slice(c, c + step)
        scores = np.repeat(const[None, part], len(x), axis=0)
        if diagonal or d <= PAIRED_FEATURES:
            gaps = [x[:, i, None] - mean[None, part, i] for i in range(d)]
            for i in range(d):
                for j in range(i, i + 1 if diagonal else d):
                    scores -= (0.5 if i == j else 1.0) * precision[None, part, i, j] * gaps[i] * gaps[j]
        else:
            gap = x[None, :, :] - mean[part, None, :]
            scores -= 0.5 * (np.matmul(gap, precision[part]) * gap).sum(axis=2).T
        own = scores.argmax(axis=1)
        top = scores[every, own]
        better = top > value
        place[better], value[better] = own[better] + c, top[better]
    return place, value


def fit_gaussian_table(df: DataFrame, x_columns: list[str], y_column: str, multivariate: bool = True) -> GaussianTable:
    """Class counts, means and (co)variances of the complete rows, in one grouped aggregate; numeric features only."""
    d = len(x_columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)] if multivariate else [(i, i) for i in range(d)]
    values = [session.number(c) for c in x_columns]
    data = df.where(session.known([y_column, *values])).select(F.col(session.quoted(y_column)).alias("label"), *[v.alias(f"z{i}") for i, v in enumerate(values)])
    moments = data.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(f"z{i}") for i in range(d)]).alias("mean"),
        F.array(*[F.expr(f"{f'var_pop(z{i})' if i == j else f'covar_pop(z{i}, z{j})'}") for i, j in pairs]).alias("spread"),
    )
    moments = session.Tables(df.sparkSession).settle(moments)
    diagonal = [pairs.index((i, i)) for i in range(d)]
    total = moments.agg(F.sum("n").alias("n"), *[F.max(F.col("spread")[i]).alias(f"v{i}") for i in diagonal]).first()
    if not total["n"]:
        raise ValueError("no complete rows to fit")
    rows, widest = total["n"], np.array(total[1:], dtype=float)
    floor = np.where(widest > 0, SMOOTHING * widest, SMOOTHING)
    schema = T.StructType([moments.schema["label"]]).add("n", "long").add("prior", "double")
    for name in ("mean", "covariance", "precision"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    schema = schema.add("const", "double").add("ridge", "double")

    def finished(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                cov = np.zeros((d, d))
                for (i, j), v in zip(pairs, row["spread"]):
                    cov[i, j] = cov[j, i] = v
                if multivariate:
                    cov, ridge = regular(cov)
                else:
                    raised = np.maximum(np.diag(cov), floor)
                    ridge, cov = float((raised - np.diag(cov)).max()), np.diag(raised)
                prior = row["n"] / rows
                const = float(np.log(prior) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]))
                out.append((row["label"], row["n"], prior, list(row["mean"]), cov.ravel(), np.linalg.inv(cov).ravel(), const, ridge))
            yield pd.DataFrame(out, columns=schema.names)

    classes = session.Tables(df.sparkSession).settle(moments.mapInPandas(finished, schema))
    return GaussianTable(list(x_columns), y_column, multivariate, classes)
