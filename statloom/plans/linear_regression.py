"""Ordinary least squares by normal equations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import session
from statloom.functions import metrics, scores
from statloom.operators.encode import MAX_ONE_HOT_LEVELS, category_levels, level_counts, one_hot, one_hot_name
from statloom.operators.joins import lookup_join
from statloom.operators.moments import complete, gram
from statloom.sources.registry import DEFAULT_ID, ModelRegistry

PREDICTION = "y_prediction"


@dataclass
class LinearModel:
    """Coefficients by feature, the intercept first."""

    x_columns: list[str]
    y_column: str
    features: list[str]
    coefficients: list[float]
    levels: dict[str, list[str]] = field(default_factory=dict)
    drop_first: bool = False
    #: The category whose levels are a table (level, effect), as they are too many for columns.
    absorbed: str | None = None
    effects: DataFrame | None = None

    def transform(self, df: DataFrame, x_columns: list[str] | None = None, output: str = PREDICTION) -> DataFrame:
        """Add the prediction; `x_columns` renames the features, in fit order."""
        given = x_columns or self.x_columns
        if len(given) != len(self.x_columns):
            raise ValueError(f"{len(self.x_columns)} columns were fitted, {len(given)} given")
        named = dict(zip(self.x_columns, given))
        terms: list = []
        numeric: list[str] = []
        weights = dict(zip(self.features, self.coefficients[1:]))
        for x in self.x_columns:
            if x == self.absorbed:
                continue
            if x in self.levels:
                values = self.levels[x][1:] if self.drop_first else self.levels[x]
                for v in values:
                    hit = F.when(F.col(session.quoted(named[x])) == F.lit(v), weights[one_hot_name(x, v)])
                    terms.append(hit.otherwise(0.0))
            else:
                numeric.append(x)
        linear = scores.linear([session.number_sql(named[x]) for x in numeric], [weights[x] for x in numeric], self.coefficients[0])
        if self.absorbed is None:
            return df.withColumn(output, reduce(add, terms, linear))
        key, effect = session.unused_names(df, ["_level", "_effect"])
        table = self.effects.select(F.col("level").alias(key), F.col("effect").alias(effect))
        keyed = df.withColumn(key, F.col(session.quoted(named[self.absorbed])).cast("string"))
        joined = lookup_join(keyed, table, [key])
        # A level unseen in the fit adds nothing, as it would in columns.
        terms.append(F.coalesce(F.col(effect), F.lit(0.0)))
        kept = [F.col(session.quoted(c)) for c in df.columns if c != output]
        return joined.select(*kept, reduce(add, terms, linear).alias(output))

    def coefficient_rows(self) -> list[tuple[int, str, float]]:
        """Coefficients that are no table's."""
        names = ["intercept", *self.features]
        return [(i, n, float(c)) for i, (n, c) in enumerate(zip(names, self.coefficients))]

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """(position, name, value) of all coefficients; levels of a table have no position."""
        rows = session.small_frame(spark, self.coefficient_rows(), "position int, name string, value double")
        if self.absorbed is None:
            return rows
        name = F.concat(F.lit(one_hot_name(self.absorbed, "")), F.col("level"))
        return rows.unionByName(self.effects.select(F.lit(None).cast("int").alias("position"), name.alias("name"), F.col("effect").alias("value")))


def fit_linear(
    df: DataFrame, x_columns: list[str], y_column: str, encode: bool = False, drop_first: bool = False, inline_levels: int = MAX_ONE_HOT_LEVELS
) -> LinearModel:
    """Means and deviations, one aggregate of centred products, then a small least-squares solve.

    Rows with a missing value are left out as a whole; a singular system gets
    its minimum-norm answer. Categories become columns while they have at most `inline_levels`
    levels together; of more, the one with most levels is a table (see `_absorbed`).
    """
    categorical = [c for c in x_columns if session.is_categorical(df, c)]
    if categorical and not encode:
        raise ValueError(f"columns {categorical} are not numeric; ask for one-hot handling")
    absorbed = None
    if categorical:
        df = df.where(session.known(categorical))
        counts = level_counts(df, categorical)
        if sum(counts.values()) > inline_levels:
            absorbed = max(categorical, key=lambda c: counts[c])
            if sum(counts.values()) - counts[absorbed] > inline_levels:
                raise ValueError(f"only one category may have many levels; {counts} are more than {inline_levels} beside the largest")
    inline = [c for c in categorical if c != absorbed]
    levels = category_levels(df, inline)
    if inline:
        df = one_hot(df, levels, drop_first)
    features: list[str] = []
    for c in x_columns:
        if c in levels:
            features += [one_hot_name(c, v) for v in (levels[c][1:] if drop_first else levels[c])]
        elif c != absorbed:
            features.append(c)
    if absorbed is not None:
        theta, effects = _absorbed(df, features, absorbed, y_column, drop_first)
        return LinearModel(list(x_columns), y_column, features, [float(t) for t in theta], levels, drop_first, absorbed, effects)
    theta = _least_squares(df, features, y_column)
    return LinearModel(list(x_columns), y_column, features, [float(t) for t in theta], levels, drop_first)


def _absorbed(df: DataFrame, features: list[str], category: str, y_column: str, drop_first: bool) -> tuple[np.ndarray, DataFrame]:
    """Least squares of which one category's levels are a table, by block elimination of the normal equations.

    The block of the levels is diagonal, so they are eliminated by centring every other column within its level: an
    aggregate by level gives the means, a second pass the centred products of the other
    columns, which alone reach the driver. A level's effect is then an expression of its
    means. Of the answers of the singular system (an intercept beside all levels, columns
    constant within levels) the one of least norm is found from sums of products over the table of levels.
    """
    spark, p = df.sparkSession, len(features)
    level = F.col(session.quoted(category)).cast("string").alias("level")
    names = [f"z{i}" for i in range(p + 1)]
    values = [session.number(c) for c in [*features, y_column]]
    data = df.select(level, *[v.alias(n) for v, n in zip(values, names)]).where(session.known(["level", *names]))
    means = [f"m{i}" for i in range(p + 1)]
    table = session.Tables(spark).settle(data.groupBy("level").agg(F.count("*").alias("n"), *[F.avg(z).alias(m) for z, m in zip(names, means)]))
    rows = table.agg(F.sum("n")).first()[0]
    if not rows:
        raise ValueError("no complete rows to fit")
    centred = lookup_join(data, table.drop("n"), ["level"]).select(*[(F.col(z) - F.col(m)).alias(z) for z, m in zip(names, means)])
    sums = gram(centred, names)[1:, 1:] / rows
    spread = np.array(table.agg(*[F.max(F.abs(m)) for m in means]).first(), dtype=float)
    scale = np.sqrt(np.diag(sums))
    constant = scale <= 1e-14 * spread
    scale = np.where(constant | (scale == 0), 1.0, scale)
    sums = sums / np.outer(scale, scale)
    sums[constant, :] = sums[:, constant] = 0.0
    kinds, vectors = np.linalg.eigh(sums[:-1, :-1])
    open_ = kinds > max(kinds.max(initial=0.0), 0.0) * p * 1e-12
    slopes = vectors[:, open_] @ ((vectors[:, open_].T @ sums[:-1, -1]) / kinds[open_]) * scale[-1] / scale[:-1]
    free = (vectors[:, ~open_] / scale[:-1, None]).T
    # A direction is (intercept, slopes, weights of [1, means]), where the weights give the effect of any level.
    answer = [0.0, slopes, np.concatenate([[0.0], -slopes, [1.0]])]
    directions = [[0.0, u, np.concatenate([[0.0], -u, [0.0]])] for u in free]
    if drop_first:
        first = table.orderBy("level").select(*means).first()
        at = np.concatenate([[1.0], np.array(first, dtype=float)])
        for d in [answer, *directions]:
            d[0] = float(d[2] @ at)
            d[2][0] -= d[0]
    else:
        directions.append([1.0, np.zeros(p), np.concatenate([[-1.0], np.zeros(p + 1)])])
    products = gram(table, means)
    inner = lambda a, b: a[0] * b[0] + a[1] @ b[1] + a[2] @ products @ b[2]
    if directions:
        shares = np.linalg.lstsq(np.array([[inner(a, b) for b in directions] for a in directions]), np.array([inner(a, answer) for a in directions]), rcond=None)[0]
        for t, d in zip(shares, directions):
            answer = [a - t * b for a, b in zip(answer, d)]
    weights = answer[2]
    effect = scores.linear([session.quoted(m) for m in means], [float(w) for w in weights[1:]], float(weights[0]))
    effects = table.select("level", effect.alias("effect"))
    if drop_first:
        effects = effects.where(F.col("level") != F.lit(table.agg(F.min("level")).first()[0]))
    return np.concatenate([[answer[0]], answer[1]]), effects


def _least_squares(df: DataFrame, features: list[str], y_column: str) -> np.ndarray:
    """Intercept and slopes of least squares; of all answers of a singular system the one of least norm.

    Products are summed of columns that are centred by their means and scaled by
    their deviations, so neither large offsets nor unequal units cost digits.
    """
    columns = [*features, y_column]
    data = complete(df, columns)
    names = data.columns
    row = data.agg(F.count("*"), *[F.avg(z) for z in names], *[F.stddev_pop(z) for z in names]).first()
    if not row[0]:
        raise ValueError("no complete rows to fit")
    mean = np.array(row[1 : 1 + len(names)], dtype=float)
    scale = np.array(row[1 + len(names) :], dtype=float)
    # What is left of a constant column after centring is rounding.
    constant = scale <= 1e-14 * np.abs(mean)
    scale = np.where(constant | (scale == 0), 1.0, scale)
    centred = data.select(*[((F.col(z) - F.lit(float(m))) / F.lit(float(s))).alias(z) for z, m, s in zip(names, mean, scale)])
    sums = gram(centred, names)[1:, 1:] / row[0]
    sums[constant, :] = sums[:, constant] = 0.0
    values, vectors = np.linalg.eigh(sums[:-1, :-1])
    open_ = values > max(values.max(initial=0.0), 0.0) * len(features) * 1e-12
    slopes = vectors[:, open_] @ ((vectors[:, open_].T @ sums[:-1, -1]) / values[open_])
    slopes = slopes * scale[-1] / scale[:-1]
    theta = np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])
    free = vectors[:, ~open_] / scale[:-1, None]
    if free.size:
        # Directions that change no fitted value, with the intercept they need, where it is more than rounding.
        needed = -(mean[:-1] @ free)
        needed[np.abs(needed) <= 1e-13 * (np.abs(mean[:-1]) @ np.abs(free))] = 0.0
        if needed.any():
            # Turned so that one direction has all of the intercept and the others exactly none.
            free = free @ np.linalg.qr(needed[:, None], mode="complete")[0]
        flat = np.linalg.qr(free[:, 1:] if needed.any() else free)[0]
        # The intercept, however large, takes no part where it is not needed, so its rounding reaches no slope.
        theta[1:] -= flat @ (flat.T @ theta[1:])
        if needed.any():
            slope = free[:, 0] - flat @ (flat.T @ free[:, 0])
            last = np.concatenate([[-(mean[:-1] @ free[:, 0])], slope])
            theta -= last * (last @ theta) / (last @ last)
    return theta


class LinearRegression:
    """Estimate, predict and score, with named saved models."""

    def __init__(self, spark: SparkSession, model_path: str | None = None):
        self.spark = spark
        self.model: LinearModel | None = None
        self.input: DataFrame | None = None
        self.predictions: DataFrame | None = None
        self.r2: float | None = None
        self.encode = False
        self.name, self.id = DEFAULT_ID, DEFAULT_ID
        self.registry = ModelRegistry(spark, model_path, "linear_regression") if model_path else None
        self._pending: tuple[list[str], str] | None = None

    def set_log_level(self, level: str) -> None:
        session.set_log_level(level)

    def create_model(
        self, table: DataFrame | str, x_columns: list[str], y_column: str, model_name: str | None = None
    ) -> "LinearRegression":
        """Set up a named model; categorical columns are always one-hot encoded."""
        self.id = self._saved().new_id(model_name)
        self.name = model_name or DEFAULT_ID
        self.input = session.as_frame(self.spark, table)
        self.encode, self._pending = True, (list(x_columns), y_column)
        self.model = self.predictions = self.r2 = None
        self._store()
        return self

    def estimate(
        self,
        table: DataFrame | str | None = None,
        x_columns: list[str] | None = None,
        y_column: str | None = None,
        ohe_handling: bool = False,
    ) -> "LinearRegression":
        """Fit the given table, or the one set up by `create_model`."""
        if table is not None:
            if not x_columns or y_column is None:
                raise ValueError("a table needs its feature columns and target")
            self.input = session.as_frame(self.spark, table)
            self.encode, self._pending = ohe_handling, (list(x_columns), y_column)
            self.name, self.id = DEFAULT_ID, DEFAULT_ID
        if self.input is None or self._pending is None:
            raise RuntimeError("no table to fit: give one or create a model first")
        self.model = fit_linear(self.input, *self._pending, encode=self.encode)
        self.predictions = self.r2 = None
        self._store()
        return self

    def predict(self, table: DataFrame | str | None = None, x_columns: list[str] | None = None) -> "LinearRegression":
        """Add predictions to the given table (default: the fitted one)."""
        source = self.input if table is None else session.as_frame(self.spark, table)
        if source is None:
            raise RuntimeError("no table to predict")
        self.predictions = self._fitted().transform(source, x_columns)
        return self

    def score(self) -> "LinearRegression":
        """R² of the predicted rows, which must hold the target."""
        if self.predictions is None:
            raise RuntimeError("predict first")
        self.r2 = metrics.r2(self.predictions, self._fitted().y_column, PREDICTION).first()["r2"]
        self._store()
        return self

    def get_coefficients(self) -> np.ndarray:
        return np.array(self._fitted().coefficients)

    def get_prediction_array(self) -> DataFrame:
        """The predictions as a one-column frame, which the caller may collect."""
        if self.predictions is None:
            raise RuntimeError("predict first")
        return self.predictions.select(PREDICTION)

    def get_score(self) -> float | None:
        return self.r2

    def get_model_list(self) -> DataFrame:
        return self._saved().models()

    def get_active_model_description(self) -> str:
        x, y = self._pending or ([], "")
        state = self._state()
        return f"model {self.name} ({self.id}): {y} ~ {' + '.join(x)}, state {state}"

    def load_model(self, model_id: str | None = None) -> "LinearRegression":
        """Bring back a saved model by id or name; its table is not stored with it."""
        meta = self._saved().require(model_id)
        self.id, self.name, self.encode = meta["id"], meta["name"], meta["encode"]
        self._pending = (meta["x_columns"], meta["y_column"])
        self.r2, self.input, self.predictions, self.model = meta["r2"], None, None, None
        if meta["state"] > 0:
            rows = self._saved().params(self.id).where("position IS NOT NULL").orderBy("position").collect()
            absorbed = meta.get("absorbed")
            start = len(one_hot_name(absorbed, "")) + 1 if absorbed else 1
            effects = self._saved().params(self.id).where("position IS NULL").select(F.expr(f"substring(name, {start})").alias("level"), F.col("value").alias("effect"))
            self.model = LinearModel(
                meta["x_columns"], meta["y_column"], [r.name for r in rows[1:]], [r.value for r in rows], meta["levels"],
                absorbed=absorbed, effects=effects if absorbed else None,
            )
        return self

    def drop_model(self, model_id: str | None = None) -> None:
        self._saved().drop(model_id)

    def _state(self) -> int:
        if self.model is None:
            return 0
        return 3 if self.r2 is not None else 2 if self.predictions is not None else 1

    def _fitted(self) -> LinearModel:
        if self.model is None:
            raise RuntimeError("estimate first")
        return self.model

    def _saved(self) -> ModelRegistry:
        if self.registry is None:
            raise RuntimeError("saved models need a model_path")
        return self.registry

    def _store(self) -> None:
        if self.registry is None or self._pending is None:
            return
        meta = {
            "name": self.name,
            "state": self._state(),
            "x_columns": self._pending[0],
            "y_column": self._pending[1],
            "encode": self.encode,
            "levels": self.model.levels if self.model else {},
            "absorbed": self.model.absorbed if self.model else None,
            "r2": self.r2,
        }
        empty = session.small_frame(self.spark, [], "position int, name string, value double")
        params = self.model.coefficient_table(self.spark) if self.model else empty
        if self.model and self.model.absorbed:
            # The effects may be read from the very table that is to be replaced.
            params = session.Tables(self.spark).settle(params)
        self.registry.save(self.id, meta, params)
