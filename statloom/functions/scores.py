"""Scoring expressions: pure projections that also run on a stream.

Small models become arithmetic on columns and stay in generated code. Models
with many terms are scored as matrix products over Arrow batches: beyond these
limits the JVM no longer compiles the generated method and runs it many times
slower, while a batch keeps its pace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.session import literal_sql

EXPRESSION_TERMS = 100
QUADRATIC_TERMS = 60


def total(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def any_null(values: list[str]) -> str:
    return "(" + " OR ".join(f"{x} IS NULL" for x in values) + ")"


def linear(values: list[str], weights: list[float], intercept: float) -> Column:
    """intercept + sum of weight * value."""
    terms = [literal_sql(intercept), *[f"{literal_sql(w)} * {x}" for x, w in zip(values, weights)]]
    return F.expr(total(terms))


def squared_distance(values: list[str], centre) -> str:
    diff = [f"({x} - {literal_sql(c)})" for x, c in zip(values, centre)]
    return total([f"{v} * {v}" for v in diff])


def nearest(values: list[str], centres: np.ndarray) -> Column:
    """struct(dist, j): least squared distance; ties go to the lowest number.

    NULL when a coordinate is NULL.
    """
    if centres.size > EXPRESSION_TERMS:
        return _nearest_by_batch(centres)(F.expr(f"array({', '.join(values)})"))
    choices = ", ".join(
        f"named_struct('dist', {squared_distance(values, c)}, 'j', {j})" for j, c in enumerate(centres)
    )
    return F.expr(f"IF({any_null(values)}, NULL, array_min(array({choices})))")


def _nearest_by_batch(centres: np.ndarray):
    @F.pandas_udf("struct<dist:double,j:int>")
    def find(points: pd.Series) -> pd.DataFrame:
        x, known = _matrix(points, centres.shape[1])
        dist = squared_distances(x, centres)
        j = dist.argmin(axis=1)
        best = dist[np.arange(len(x)), j]
        found = pd.DataFrame({"dist": pd.array(best, dtype="Float64"), "j": pd.array(j, dtype="Int32")})
        found.loc[~known] = pd.NA
        return found

    return find


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows by centres, summed coordinate by coordinate as the expression does."""
    dist = np.zeros((len(x), len(centres)))
    for l in range(x.shape[1]):
        diff = x[:, l, None] - centres[None, :, l]
        dist += diff * diff
    return dist


def _matrix(points: pd.Series, d: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(points):
        return np.zeros((0, d)), np.zeros(0, dtype=bool)
    x = np.array([np.asarray(p, dtype=float) for p in points])
    return x, ~np.isnan(x).any(axis=1)


def quadratic(values: list[str], mean, precision) -> str:
    """(x - mean)' precision (x - mean), without the terms that are 0."""
    diff = [f"({x} - {literal_sql(m)})" for x, m in zip(values, mean)]
    terms = [
        f"{literal_sql(precision[i, j] * (1.0 if i == j else 2.0))} * {diff[i]} * {diff[j]}"
        for i in range(len(mean))
        for j in range(i, len(mean))
        if precision[i, j] != 0.0
    ]
    return total(terms)


def gaussian_log_scores(values: list[str], classes: list[dict]) -> list[str]:
    """Per class: log(prior * density), from `const`, `mean` and `precision`."""
    return [
        f"({literal_sql(c['const'])} - 0.5D * {quadratic(values, c['mean'], c['precision'])})" for c in classes
    ]


def has_few_terms(classes: list[dict]) -> bool:
    return sum(int(np.count_nonzero(np.triu(c["precision"]))) for c in classes) <= QUADRATIC_TERMS


def gaussian_scores(values: list[str], classes: list[dict]) -> Column:
    """Array of log(prior * density), one entry per class; NULL when a feature is NULL."""
    if has_few_terms(classes):
        return F.expr(f"IF({any_null(values)}, NULL, array({', '.join(gaussian_log_scores(values, classes))}))")
    score = _batch_scores(classes)

    @F.pandas_udf("array<double>")
    def every(points: pd.Series) -> pd.Series:
        scores, known = score(points)
        return pd.Series([row if ok else None for row, ok in zip(scores, known)])

    return every(F.expr(f"array({', '.join(values)})"))


def gaussian_best(values: list[str], classes: list[dict]) -> Column:
    """struct(score, at): the class with the greatest score; ties go to the first."""
    last = len(classes) - 1
    if has_few_terms(classes):
        ranked = ", ".join(
            f"named_struct('score', {score}, 'back', {last - c})"
            for c, score in enumerate(gaussian_log_scores(values, classes))
        )
        top = F.expr(f"IF({any_null(values)}, NULL, array_max(array({ranked})))")
        return F.struct(top["score"].alias("score"), (F.lit(last) - top["back"]).alias("at"))
    score = _batch_scores(classes)

    @F.pandas_udf("struct<score:double,at:int>")
    def top_one(points: pd.Series) -> pd.DataFrame:
        scores, known = score(points)
        at = scores.argmax(axis=1)
        best = scores[np.arange(len(scores)), at]
        found = pd.DataFrame({"score": pd.array(best, dtype="Float64"), "at": pd.array(at, dtype="Int32")})
        found.loc[~known] = pd.NA
        return found

    return top_one(F.expr(f"array({', '.join(values)})"))


def _batch_scores(classes: list[dict]):
    means = np.array([c["mean"] for c in classes])
    precisions = np.array([c["precision"] for c in classes])
    consts = np.array([c["const"] for c in classes])

    def score(points: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x, known = _matrix(points, means.shape[1])
        out = np.empty((len(x), len(consts)))
        for c in range(len(consts)):
            diff = x - means[c]
            out[:, c] = consts[c] - 0.5 * ((diff @ precisions[c]) * diff).sum(axis=1)
        return np.where(np.isnan(out), -np.inf, out), known

    return score


def batch_distances(values: list[str], classes: list[dict]) -> Column:
    """Array of (x - mean)' precision (x - mean), one entry per class; NULL when a feature is NULL."""
    means = np.array([c["mean"] for c in classes])
    precisions = np.array([c["precision"] for c in classes])

    @F.pandas_udf("array<double>")
    def every(points: pd.Series) -> pd.Series:
        x, known = _matrix(points, means.shape[1])
        diffs = [x - m for m in means]
        found = np.column_stack([((d @ p) * d).sum(axis=1) for d, p in zip(diffs, precisions)])
        return pd.Series([row if ok else None for row, ok in zip(found, known)], dtype=object)

    return every(F.expr(f"array({', '.join(values)})"))


def xlog2x(value: str) -> str:
    """x * log2(x), 0 at x = 0."""
    return f"IF({value} > 0, {value} * log2({value}), 0D)"
