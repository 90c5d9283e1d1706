"""Gaussian classifiers: one grouped aggregate to fit, one projection to score."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import session
from statloom.functions import metrics, scores
from statloom.operators.encode import apply_ordinal, category_levels
from statloom.operators.moments import grouped_moments
from statloom.operators.split import bernoulli_split
from statloom.sources.registry import DEFAULT_ID, ModelRegistry

PREDICTION = "y_prediction"
PROBABILITY = "probability"
SMOOTHING = 1e-9


@dataclass
class GaussianClass:
    """Fitted parameters of one class; `ridge` is what was added to its diagonal."""

    label: Any
    n: int
    prior: float
    mean: np.ndarray
    cov: np.ndarray
    ridge: float = 0.0

    def __post_init__(self) -> None:
        d = len(self.mean)
        sign, log_det = np.linalg.slogdet(self.cov)
        self.det = float(sign * np.exp(log_det))
        self.precision = np.linalg.inv(self.cov)
        self.const = float(np.log(self.prior) - 0.5 * (d * np.log(2 * np.pi) + log_det))

    def terms(self) -> dict[str, Any]:
        return {"const": self.const, "mean": self.mean, "precision": self.precision}


@dataclass
class GaussianModel:
    """Class densities over numeric features; string features travel as ordinals."""

    x_columns: list[str]
    y_column: str
    label_type: T.DataType
    classes: list[GaussianClass]
    multivariate: bool
    levels: dict[str, list[str]] = field(default_factory=dict)

    def _values(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        helpers = dict(zip(self.levels, session.unused_names(df, [f"_code_{i}" for i in range(len(self.levels))])))
        for c, name in helpers.items():
            df = apply_ordinal(df, c, self.levels[c], name)
        return df, [session.number_sql(helpers.get(c, c)) for c in self.x_columns], list(helpers.values())

    def _labels(self) -> Column:
        return F.array(*[F.lit(c.label).cast(self.label_type) for c in self.classes])

    def transform(self, df: DataFrame, output: str = PREDICTION, probability: str = PROBABILITY) -> DataFrame:
        """Add the class of the greatest prior * density (ties: first class) and that product."""
        df, values, helpers = self._values(df)
        best = scores.gaussian_best(values, [c.terms() for c in self.classes])
        (found,) = session.unused_names(df, ["_best"])
        return (
            df.withColumn(found, best)
            .withColumn(output, F.get(self._labels(), F.col(found)["at"]))
            .withColumn(probability, F.exp(F.col(found)["score"]))
            .drop(found, *helpers)
        )

    def class_probabilities(self, df: DataFrame, label: str = "y_class", probability: str = PROBABILITY) -> DataFrame:
        """One row per input row and class, with prior * density."""
        df, values, helpers = self._values(df)
        found = F.arrays_zip(
            self._labels().alias(label),
            scores.gaussian_scores(values, [c.terms() for c in self.classes]).alias(probability),
        )
        columns = [session.quoted(c) for c in df.columns if c not in helpers]
        return df.select(*columns, F.inline_outer(found)).withColumn(probability, F.exp(F.col(probability)))

    def mahalanobis(self, df: DataFrame, label: str = "y_class", distance: str = "distance") -> DataFrame:
        """One row per input row and class, with (x - mean)' S^-1 (x - mean)."""
        df, values, helpers = self._values(df)
        terms = [c.terms() for c in self.classes]
        columns = [session.quoted(c) for c in df.columns if c not in helpers]
        if not scores.has_few_terms(terms):
            # Too many terms for generated code: distances by whole batches.
            found = F.arrays_zip(self._labels().alias(label), scores.batch_distances(values, terms).alias(distance))
            return df.select(*columns, F.inline(F.coalesce(found, self._no_distance(label, distance))))
        each = [
            F.struct(
                F.lit(c.label).cast(self.label_type).alias(label),
                F.expr(scores.quadratic(values, c.mean, c.precision)).alias(distance),
            )
            for c in self.classes
        ]
        return df.select(*columns, F.inline(F.array(*each)))

    def _no_distance(self, label: str, distance: str) -> Column:
        missing = F.lit(None).cast("double").alias(distance)
        return F.array(*[F.struct(F.lit(c.label).cast(self.label_type).alias(label), missing) for c in self.classes])

    def parameter_rows(self) -> list[tuple]:
        return [
            (c.label, int(c.n), float(c.prior), x, float(c.mean[i]), float(c.cov[i, i]))
            for c in self.classes
            for i, x in enumerate(self.x_columns)
        ]

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(y, n, prior, feature, mean, variance)."""
        return session.small_frame(spark, self.parameter_rows(), self._schema("n long, prior double, feature string, mean double, variance double"))

    def priors(self, spark: SparkSession) -> DataFrame:
        return session.small_frame(spark, [(c.label, int(c.n), float(c.prior)) for c in self.classes], self._schema("n long, prior double")
        )

    def covariances(self, spark: SparkSession) -> DataFrame:
        """(y, i, j, covariance, inverse), features counted from 1."""
        d = len(self.x_columns)
        rows = [
            (c.label, i + 1, j + 1, float(c.cov[i, j]), float(c.precision[i, j]))
            for c in self.classes
            for i in range(d)
            for j in range(d)
        ]
        return session.small_frame(spark, rows, self._schema("i int, j int, covariance double, inverse double"))

    def determinants(self, spark: SparkSession) -> DataFrame:
        rows = [(c.label, c.det, float(c.ridge)) for c in self.classes]
        return session.small_frame(spark, rows, self._schema("determinant double, ridge double"))

    def _schema(self, rest: str) -> T.StructType:
        return T.StructType([T.StructField("y", self.label_type), *T.StructType.fromDDL(rest).fields])


def regular(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The matrix, with a growing ridge when it has no usable inverse."""
    scale = float(np.trace(cov)) / len(cov)
    scale = scale if scale > 0 else 1.0
    spread = np.where(np.diag(cov) > 0, np.sqrt(np.abs(np.diag(cov))), 1.0)
    ridge = 0.0
    while True:
        tried = cov + ridge * np.eye(len(cov))
        correlation = tried / np.outer(spread, spread)
        if np.linalg.eigvalsh(correlation)[0] > 1e-12 and np.all(np.diag(tried) > 0):
            return tried, ridge
        ridge = max(ridge * 10, SMOOTHING * scale)


def fit_gaussian(df: DataFrame, x_columns: list[str], y_column: str, multivariate: bool = True) -> GaussianModel:
    """Class counts, means and (co)variances of the complete rows, in one aggregate."""
    categorical = [c for c in x_columns if session.is_categorical(df, c)]
    levels = category_levels(df, categorical)
    data, columns = df, list(x_columns)
    for c, code in zip(categorical, session.unused_names(df, [f"_code_{i}" for i in range(len(categorical))])):
        data = apply_ordinal(data, c, levels[c], code)
        columns[columns.index(c)] = code
    groups = grouped_moments(data, columns, y_column, diagonal=not multivariate)
    if not groups:
        raise ValueError("no complete rows to fit")
    rows = sum(g.n for g in groups)
    widest = np.max([np.diag(g.cov) for g in groups], axis=0)
    floor = np.where(widest > 0, SMOOTHING * widest, SMOOTHING)
    classes = []
    for g in groups:
        cov, ridge = g.cov, 0.0
        if multivariate:
            cov, ridge = regular(cov)
        else:
            raised = np.maximum(np.diag(cov), floor)
            ridge = float((raised - np.diag(cov)).max())
            cov = np.diag(raised)
        classes.append(GaussianClass(g.key, g.n, g.n / rows, g.mean, cov, ridge))
    return GaussianModel(list(x_columns), y_column, df.schema[y_column].dataType, classes, multivariate, levels)


class GaussianClassifier:
    """Split, estimate, predict and score, with named saved models."""

    def __init__(self, spark: SparkSession, model_path: str | None = None):
        self.spark = spark
        self.model: GaussianModel | None = None
        self.table: DataFrame | None = None
        self.train: DataFrame | None = None
        self.evaluation: DataFrame | None = None
        self.predictions: DataFrame | None = None
        self.accuracy: float | None = None
        self.x_columns: list[str] = []
        self.y_column = ""
        self.multivariate = True
        self.name, self.id = DEFAULT_ID, DEFAULT_ID
        self.registry = ModelRegistry(spark, model_path, "gaussian") if model_path else None

    def set_log_level(self, level: str) -> None:
        session.set_log_level(level)

    def create_model(
        self,
        table: DataFrame | str,
        x_columns: list[str],
        y_column: str,
        model_name: str | None = None,
        multivariate: bool = True,
    ) -> "GaussianClassifier":
        self.id = self._saved().new_id(model_name)
        self.name = model_name or DEFAULT_ID
        self._take(table, x_columns, y_column, multivariate)
        self._store()
        return self

    def train_test_split(self, ratio: float = 0.8, seed: int = 1, id_col: str | None = None) -> "GaussianClassifier":
        if self.table is None:
            raise RuntimeError("no table to split")
        self.train, self.evaluation = bernoulli_split(self.table, ratio, seed, id_col)
        return self

    def estimate(
        self,
        table: DataFrame | str | None = None,
        x_columns: list[str] | None = None,
        y_column: str | None = None,
        multivariate: bool | None = None,
        ratio: float | None = 0.8,
        seed: int = 1,
        id_col: str | None = None,
    ) -> "GaussianClassifier":
        """Fit on a seeded part of the table; `ratio=None` fits and predicts all of it."""
        if table is not None:
            if not x_columns or y_column is None:
                raise ValueError("a table needs its feature columns and target")
            self.name, self.id = DEFAULT_ID, DEFAULT_ID
            self._take(table, x_columns, y_column, True if multivariate is None else multivariate)
        elif multivariate is not None:
            self.multivariate = multivariate
        if self.table is None:
            raise RuntimeError("no table to fit: give one or create a model first")
        if self.train is None:
            if ratio is None:
                self.train = self.evaluation = self.table
            else:
                self.train_test_split(ratio, seed, id_col)
        self.model = fit_gaussian(self.train, self.x_columns, self.y_column, self.multivariate)
        self.predictions = self.accuracy = None
        self._store()
        return self

    def predict(self, table: DataFrame | str | None = None) -> "GaussianClassifier":
        source = self.evaluation if table is None else session.as_frame(self.spark, table)
        if source is None:
            raise RuntimeError("no table to predict")
        self.predictions = self._fitted().transform(source)
        return self

    def score(self) -> "GaussianClassifier":
        self.accuracy = metrics.accuracy(self._predicted(), self.y_column, PREDICTION).first()["accuracy"]
        self._store()
        return self

    def get_accuracy(self) -> float | None:
        return self.accuracy

    def get_prediction_array(self) -> DataFrame:
        return self._predicted().select(PREDICTION)

    def get_target_array(self) -> DataFrame:
        return self._predicted().select(self.y_column)

    def get_model_list(self) -> DataFrame:
        return self._saved().models()

    def get_active_model_description(self) -> str:
        kind = "multivariate" if self.multivariate else "univariate"
        return f"model {self.name} ({self.id}): {kind} {self.y_column} ~ {' + '.join(self.x_columns)}, state {self._state()}"

    def load_model(self, model_id: str | None = None) -> "GaussianClassifier":
        meta = self._saved().require(model_id)
        self.id, self.name = meta["id"], meta["name"]
        self.x_columns, self.y_column, self.multivariate = meta["x_columns"], meta["y_column"], meta["multivariate"]
        self.accuracy, self.model = meta["accuracy"], None
        self.table = self.train = self.evaluation = self.predictions = None
        if meta["state"] > 0:
            rows = self._saved().params(self.id)
            classes = [
                GaussianClass(r.y, r.n, r.prior, np.array(r["mean"]), np.array(r.cov).reshape(len(r["mean"]), -1), r.ridge)
                for r in rows.collect()
            ]
            classes.sort(key=lambda c: c.label)
            self.model = GaussianModel(
                self.x_columns, self.y_column, rows.schema["y"].dataType, classes, self.multivariate, meta["levels"]
            )
        return self

    def drop_model(self, model_id: str | None = None) -> None:
        self._saved().drop(model_id)

    def clean_up(self) -> None:
        """Forget the split and the predictions; the fitted model stays."""
        self.train = self.evaluation = self.predictions = None

    def _take(self, table, x_columns, y_column, multivariate) -> None:
        self.table = session.as_frame(self.spark, table)
        self.x_columns, self.y_column, self.multivariate = list(x_columns), y_column, multivariate
        self.model = self.accuracy = None
        self.clean_up()

    def _state(self) -> int:
        if self.model is None:
            return 0
        return 3 if self.accuracy is not None else 2 if self.predictions is not None else 1

    def _fitted(self) -> GaussianModel:
        if self.model is None:
            raise RuntimeError("estimate first")
        return self.model

    def _predicted(self) -> DataFrame:
        if self.predictions is None:
            raise RuntimeError("predict first")
        return self.predictions

    def _saved(self) -> ModelRegistry:
        if self.registry is None:
            raise RuntimeError("saved models need a model_path")
        return self.registry

    def _store(self) -> None:
        if self.registry is None:
            return
        model = self.model
        label = model.label_type if model else T.StringType()
        schema = T.StructType(
            [
                T.StructField("y", label),
                *T.StructType.fromDDL("n long, prior double, mean array<double>, cov array<double>, ridge double").fields,
            ]
        )
        rows = [
            (c.label, int(c.n), float(c.prior), c.mean.tolist(), c.cov.ravel().tolist(), float(c.ridge))
            for c in (model.classes if model else [])
        ]
        meta = {
            "name": self.name,
            "state": self._state(),
            "x_columns": self.x_columns,
            "y_column": self.y_column,
            "multivariate": self.multivariate,
            "levels": model.levels if model else {},
            "accuracy": self.accuracy,
        }
        self.registry.save(self.id, meta, session.small_frame(self.spark, rows, schema))
