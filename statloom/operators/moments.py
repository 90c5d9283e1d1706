"""Sums of products, covariances and other one-pass algebraic aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import bounded_rows, known, number, quoted

EXPRESSION_COLUMNS = 12
EXPRESSION_PAIRS = 28
MAX_GROUPS = 10_000


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, rows with a missing value left out."""
    values = [number(c) for c in columns]
    return df.where(known(columns)).where(known(values)).select(*[v.alias(f"z{i}") for i, v in enumerate(values)])


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles and nothing else, for use in batches."""
    return df.select(*[F.col(quoted(c)).cast("double").alias(f"z{i}") for i, c in enumerate(columns)])


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of all products of [1, *columns] over the rows without missing values.

    One aggregate with map-side partial sums; wide inputs are multiplied as
    matrices per Arrow batch and only the sums are shuffled.
    """
    size = len(columns) + 1
    result = np.zeros((size, size))
    if len(columns) <= EXPRESSION_COLUMNS:
        data = complete(df, columns)
        z = ["1D", *[f"z{i}" for i in range(len(columns))]]
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        row = data.selectExpr(*[f"sum({z[i]} * {z[j]}) AS s{i}_{j}" for i, j in pairs]).first()
        for i, j in pairs:
            result[i, j] = result[j, i] = row[f"s{i}_{j}"] or 0.0
        return result

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch.to_numpy(dtype=float)])
            z = z[~np.isnan(z).any(axis=1)]
            total += z.T @ z
        at = np.triu_indices(size)
        yield pd.DataFrame({"i": at[0], "j": at[1], "s": total[at]})

    sums = doubles(df, columns).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.collect():
        result[r.i, r.j] = result[r.j, r.i] = r.s
    return result


@dataclass
class GroupMoments:
    """Row count, means and population covariance of one class."""

    key: Any
    n: int
    mean: np.ndarray
    cov: np.ndarray


def grouped_moments(df: DataFrame, columns: list[str], key: str, diagonal: bool) -> list[GroupMoments]:
    """Per-class count, means and population (co)variances, sorted by class."""
    d = len(columns)
    pairs = [(i, i) for i in range(d)] if diagonal else [(i, j) for i in range(d) for j in range(i, d)]
    if len(pairs) > EXPRESSION_PAIRS:
        return _wide_moments(df, columns, key, diagonal)
    values = [number(c) for c in columns]
    data = df.where(known([key, *values])).select(
        F.col(quoted(key)).alias("key"), *[v.alias(f"z{i}") for i, v in enumerate(values)]
    )
    moments = data.groupBy("key").agg(
        F.count("*").alias("n"),
        *[F.expr(f"avg(z{i}) AS m{i}") for i in range(d)],
        *[F.expr(f"{f'var_pop(z{i})' if i == j else f'covar_pop(z{i}, z{j})'} AS c{i}_{j}") for i, j in pairs],
    )
    groups = []
    for r in bounded_rows(moments, MAX_GROUPS, "classes"):
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        groups.append(GroupMoments(r.key, r.n, np.array([r[f"m{i}"] for i in range(d)]), cov))
    return sorted(groups, key=lambda g: g.key)


def _wide_moments(df: DataFrame, columns: list[str], key: str, diagonal: bool) -> list[GroupMoments]:
    """The same from matrix products per Arrow batch.

    Sums are taken around the exact mean of each class, which an aggregate of
    its own finds first, so large values do not swallow small variances.
    """
    d = len(columns)
    names = [f"z{i}" for i in range(d)]
    data = df.select(
        F.col(quoted(key)).alias("key"),
        *[F.col(quoted(c)).cast("double").alias(n) for c, n in zip(columns, names)],
    ).where(F.col("key").isNotNull())
    whole = data.where(known([number(n) for n in names]))
    means = whole.groupBy("key").agg(*[F.avg(n).alias(n) for n in names])
    centres = {r.key: np.array([r[n] for n in names]) for r in bounded_rows(means, MAX_GROUPS, "classes")}
    pairs = (np.arange(d), np.arange(d)) if diagonal else np.triu_indices(d)
    width = 1 + d + len(pairs[0])
    schema = f"key {data.schema['key'].dataType.simpleString()}, sums array<double>"

    def partial(batches):
        totals: dict[Any, np.ndarray] = {}
        for batch in batches:
            for value, group in batch.groupby("key", sort=False):
                z = group[names].to_numpy(dtype=float)
                z = z[~np.isnan(z).any(axis=1)]
                if not len(z):
                    continue
                z = z - centres[value]
                squares = (z * z).sum(axis=0) if diagonal else (z.T @ z)[pairs]
                part = np.concatenate([[len(z)], z.sum(axis=0), squares])
                totals[value] = totals.get(value, np.zeros(width)) + part
        if totals:
            yield pd.DataFrame({"key": list(totals), "sums": list(totals.values())})

    summed = (
        data.mapInPandas(partial, schema)
        .select("key", F.posexplode("sums").alias("at", "s"))
        .groupBy("key", "at")
        .agg(F.sum("s").alias("s"))
    )
    found: dict[Any, np.ndarray] = {}
    for r in bounded_rows(summed, MAX_GROUPS * width, "class moments"):
        found.setdefault(r.key, np.zeros(width))[r["at"]] = r.s
    groups = []
    for key in sorted(found):
        sums = found[key]
        if not sums[0]:
            continue
        n, shift = sums[0], sums[1 : 1 + d] / sums[0]
        cov = np.zeros((d, d))
        cov[pairs] = sums[1 + d :] / n
        cov = np.triu(cov) + np.triu(cov, 1).T
        cov -= np.diag(shift * shift) if diagonal else np.outer(shift, shift)
        groups.append(GroupMoments(key, int(n), centres[key] + shift, cov))
    return groups
