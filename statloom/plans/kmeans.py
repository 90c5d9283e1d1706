"""k-means by Lloyd's steps: one aggregate job per step."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom import session
from statloom.functions import scores
from statloom.operators.silhouette import euclidean_silhouette, squared_silhouette
from statloom.sources.registry import ModelRegistry

NORMALISATIONS = (None, "min-max", "z-score")
SAMPLE_PER_CLUSTER = 500
ROUNDING = 1e-13


def scaling(df: DataFrame, features: list[str], normalization: str | None) -> tuple[int, list[tuple]]:
    """Row count and, per feature, the (shift, divisor) of its normalisation, in one aggregate."""
    if normalization not in NORMALISATIONS:
        raise ValueError(f"normalization must be one of {NORMALISATIONS}")
    if normalization is None:
        return df.count(), [(0.0, 1.0)] * len(features)
    low = F.min if normalization == "min-max" else F.avg
    row = df.agg(
        F.count("*").alias("n"),
        *[low(session.number(c)).alias(f"a{i}") for i, c in enumerate(features)],
        *[
            (
                F.max(session.number(c)) - F.min(session.number(c))
                if normalization == "min-max"
                else F.stddev_pop(session.number(c))
            ).alias(f"b{i}")
            for i, c in enumerate(features)
        ],
    ).first()
    return row["n"], [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(features))]


def scaled_sql(feature: str, shift: float | None, divisor: float | None) -> str:
    """(x - shift) / divisor; NULL for a constant feature, whose divisor is 0."""
    x = session.number_sql(feature)
    if (shift, divisor) == (0.0, 1.0):
        return x
    if not divisor:
        return "CAST(NULL AS DOUBLE)"
    return f"(({x} - {session.literal_sql(shift)}) / {session.literal_sql(divisor)})"


def scaled(feature: str, shift: float | None, divisor: float | None) -> Column:
    return F.expr(scaled_sql(feature, shift, divisor))


def normalise(df: DataFrame, features: list[str], normalization: str | None, out: list[str] | None = None) -> DataFrame:
    """Add the normalised features, named `x_<position>` unless `out` says otherwise."""
    out = out or coordinates(len(features))
    _, scales = scaling(df, features, normalization)
    return df.select("*", *[scaled(c, *s).alias(o) for c, s, o in zip(features, scales, out)])


def coordinates(d: int) -> list[str]:
    return [f"x_{l}" for l in range(d)]


def start_rows(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """k different rows, chosen by a seeded hash of their values.

    One representative per hash cell, the row of least hash, comes out of a
    partial aggregate over plain numbers, so nothing is sorted and copies of a
    row collapse before anything is shuffled.
    """
    names = points.columns
    known = points.where(session.known(names))
    digest = F.xxhash64(*names, F.lit(seed))
    cell = F.pmod(digest, F.lit(64 * k)).alias("cell")
    hashed = known.select(*names, cell, digest.alias("h"))
    least = hashed.groupBy("cell").agg(*[F.expr(f"min_by({c}, h) AS {c}") for c in names], F.min("h").alias("h"))
    chosen = least.collect()
    if len(chosen) < k:
        chosen = known.distinct().select(*names, digest.alias("h")).orderBy("h").limit(k).collect()
    if len(chosen) < k:
        raise ValueError(f"{k} clusters need {k} different complete rows, found {len(chosen)}")
    chosen.sort(key=lambda r: r.h)
    return np.array([[r[c] for c in names] for r in chosen[:k]], dtype=float)


class KMeansModel:
    """Centroids and the table they are fitted to."""

    def __init__(
        self,
        spark: SparkSession,
        table: DataFrame | None,
        features: list[str],
        scales: list[tuple],
        centroids: np.ndarray,
        rows: int,
        name: str,
        normalization: str | None = None,
        registry: ModelRegistry | None = None,
        model_id: str | None = None,
    ):
        self.spark, self.table, self.features, self.scales = spark, table, list(features), scales
        self.centroids = centroids
        self.assigned_by = centroids
        self.rows, self.steps = rows, 0
        self.variance: float | None = None
        self.name, self.normalization = name, normalization
        self.registry, self.model_id = registry, model_id

    def estimate(self, max_steps: int = 100, cache: bool = True) -> "KMeansModel":
        """Run at most `max_steps` more steps; stop when the variance stays the same.

        Sums arrive in any order, so "the same" allows their rounding.
        """
        data = self._points()
        if cache:
            data = data.persist()
        last: float | None = None
        try:
            for _ in range(max_steps):
                self.variance, moved = self._step(data)
                self.assigned_by = self.centroids
                self.steps += 1
                session.logger.info("k-means: %d steps done, variance now %s", self.steps, self.variance)
                if last is not None and abs(self.variance - last) <= ROUNDING * abs(last):
                    break
                last, self.centroids = self.variance, moved
        finally:
            if cache:
                data.unpersist()
        self._store()
        return self

    def _step(self, data: DataFrame) -> tuple[float, np.ndarray]:
        """Assign, and sum cost and coordinates per cluster, in one job."""
        names = coordinates(len(self.features))
        if self._in_batches():
            sums = _wide_sums(data, self.centroids)
        else:
            best = scores.nearest(names, self.centroids)
            found = (
                data.select(best.alias("b"), *names)
                .groupBy(F.col("b.j").alias("j"))
                .agg(F.count("*").alias("n"), F.sum("b.dist").alias("cost"), *[F.expr(f"sum({c}) AS {c}") for c in names])
                .collect()
            )
            sums = {r.j: np.array([r.n, r.cost, *[r[c] for c in names]], dtype=float) for r in found}
        if not sums:
            raise ValueError("no complete rows to cluster")
        moved = self.centroids.copy()
        for j, s in sums.items():
            moved[j] = s[2:] / s[0]
        return float(sum(s[1] for s in sums.values()) / self.rows), moved

    def _table(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("a loaded model needs its table: load_model(name, table)")
        return self.table

    def _scaled(self) -> list[Column]:
        return [scaled(c, *s) for c, s in zip(self.features, self.scales)]

    def _points(self) -> DataFrame:
        """Normalised features; of the complete rows, unless batches pick them out."""
        values = self._scaled()
        named = [v.alias(x) for v, x in zip(values, coordinates(len(values)))]
        rows = self._table() if self._in_batches() else self._table().where(session.known(values))
        return rows.select(*named)

    def _in_batches(self) -> bool:
        return self.centroids.size > scores.EXPRESSION_TERMS

    def _assigned_points(self) -> DataFrame:
        """The same with the cluster `j` of the last step."""
        names = coordinates(len(self.features))
        best = scores.nearest(names, self.assigned_by)
        points = self._points().select(*names, best["j"].alias("j"))
        return points.where("j IS NOT NULL") if self._in_batches() else points

    def transform(self, df: DataFrame, centroids: np.ndarray | None = None) -> DataFrame:
        """Add `min_dist` and cluster `j` by the given (default: current) centroids."""
        best = scores.nearest([scaled_sql(c, *s) for c, s in zip(self.features, self.scales)], self.centroids if centroids is None else centroids)
        (found,) = session.unused_names(df, ["_b"])
        return df.withColumn(found, best).select(
            *[session.quoted(c) for c in df.columns], F.col(found)["dist"].alias("min_dist"), F.col(found)["j"].alias("j")
        )

    def assignments(self) -> DataFrame:
        """The table with normalised features, `min_dist` and `j` as of the last step."""
        names = coordinates(len(self.features))
        best = scores.nearest(names, self.assigned_by)
        points = self._table().select("*", *[v.alias(x) for v, x in zip(self._scaled(), names)])
        (found,) = session.unused_names(points, ["_b"])
        return points.withColumn(found, best).select(
            *[session.quoted(c) for c in points.columns], F.col(found)["dist"].alias("min_dist"), F.col(found)["j"].alias("j")
        )

    def centroid_table(self) -> DataFrame:
        """(j, l, value), both counted from 0."""
        cells = [(j, l, float(v)) for j, row in enumerate(self.centroids) for l, v in enumerate(row)]
        return session.small_frame(self.spark, cells, "j int, l int, value double")

    def get_information(self) -> dict[str, Any]:
        k, d = self.centroids.shape
        return {"n": self.rows, "d": d, "k": k, "steps": self.steps, "variance": self.variance}

    def get_silhouette_avg(self, metric: str = "euclidean") -> float | None:
        """Average silhouette.

        "euclidean" takes all pairs: of many different rows in one or two features far cells are
        summed by interpolation to about 1e-12, otherwise it is quadratic work in the number
        of different rows; "squared" is linear work on per-cluster sums.
        """
        names = coordinates(len(self.features))
        points = self._assigned_points()
        if metric == "euclidean":
            return euclidean_silhouette(points, names, "j")
        if metric == "squared":
            return squared_silhouette(points, names, "j")
        raise ValueError("metric must be 'euclidean' or 'squared'")

    def cluster_sample(self, per_cluster: int = SAMPLE_PER_CLUSTER, seed: int = 1) -> DataFrame:
        """Distinct rows among `per_cluster` of every cluster, for a chart.

        A row's place is a seeded hash of its values, taken in the order of the features' names,
        so the sample is spread over the cluster. Each task keeps the first of its own rows of a
        cluster before any are moved.
        """
        names = coordinates(len(self.features))
        raw = [session.number(c).cast("string") for c in sorted(self.features)]
        draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *raw).cast("binary"))
        values = self._scaled()
        (place,) = session.unused_names(self._table(), ["_place"])
        points = self._table().where(session.known(values)).select(*[v.alias(x) for v, x in zip(values, names)], draw.alias(place))
        near = points.select("*", scores.nearest(names, self.assigned_by)["j"].alias("j"))
        window = Window.partitionBy("j").orderBy(place, *names)
        first = near.withColumn(place, F.row_number().over(window)).where(F.col(place) <= per_cluster)
        return first.select(*names, "j").distinct()

    def _store(self) -> None:
        if self.registry is None or self.model_id is None:
            return
        meta = {
            "name": self.name,
            "state": 1 if self.steps else 0,
            "features": self.features,
            "normalization": self.normalization,
            "scales": self.scales,
            **self.get_information(),
        }
        rows = [
            (kind, j, l, float(v))
            for kind, table in (("current", self.centroids), ("assigned_by", self.assigned_by))
            for j, row in enumerate(table)
            for l, v in enumerate(row)
        ]
        self.registry.save(self.model_id, meta, session.small_frame(self.spark, rows, "kind string, j int, l int, value double"))


def _wide_sums(data: DataFrame, centroids: np.ndarray) -> dict[int, np.ndarray]:
    """Per cluster [count, cost, coordinate sums], added up inside each task first."""
    k, d = centroids.shape

    def partial(batches):
        total = np.zeros((k, d + 2))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            x = x[~np.isnan(x).any(axis=1)]
            if not len(x):
                continue
            dist = scores.squared_distances(x, centroids)
            j = dist.argmin(axis=1)
            one_of = np.zeros((len(x), k))
            one_of[np.arange(len(x)), j] = 1.0
            part = np.column_stack([np.ones(len(x)), dist[np.arange(len(x)), j], x])
            total += one_of.T @ part
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pd.DataFrame({"j": used, "sums": [total[u] for u in used]})

    rows = (
        data.mapInPandas(partial, "j int, sums array<double>")
        .select("j", F.posexplode("sums").alias("at", "s"))
        .groupBy("j", "at")
        .agg(F.sum("s").alias("s"))
        .collect()
    )
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r.j, np.zeros(d + 2))[r["at"]] = r.s
    return sums


class KMeans:
    """Creates, loads and drops k-means models."""

    def __init__(self, spark: SparkSession, model_path: str | None = None):
        self.spark = spark
        self.registry = ModelRegistry(spark, model_path, "kmeans") if model_path else None
        self.silhouettes: dict[int, float | None] = {}

    def create_model(
        self,
        table: DataFrame | str,
        feature_names: list[str],
        k: int,
        model_identifier: str,
        normalization: str | None = None,
        start: list[list[float]] | None = None,
        seed: int = 1,
    ) -> KMeansModel:
        """Normalise the features and take k start rows.

        `start` gives start centroids in the table's own units instead.
        """
        frame = session.as_frame(self.spark, table)
        name = f"{table}_{model_identifier}" if isinstance(table, str) else model_identifier
        rows, scales = scaling(frame, feature_names, normalization)
        if start is not None:
            if len(start) != k or any(len(s) != len(feature_names) for s in start):
                raise ValueError("start needs k rows with one value per feature")
            if any(not b for _, b in scales):
                raise ValueError("a constant feature cannot be normalised")
            centroids = np.array([[(v - a) / b for v, (a, b) in zip(s, scales)] for s in start], dtype=float)
        else:
            named = zip(feature_names, scales, coordinates(len(scales)))
            points = frame.select(*[scaled(c, *s).alias(o) for c, s, o in named])
            centroids = start_rows(points, k, seed)
        model_id = None
        if self.registry is not None:
            if self.registry.find(name) is not None:
                self.registry.drop(name)
            model_id = self.registry.new_id(name)
        model = KMeansModel(self.spark, frame, feature_names, scales, centroids, rows, name, normalization, self.registry, model_id)
        model._store()
        return model

    def create_ideal_model(
        self,
        table: DataFrame | str,
        feature_names: list[str],
        k_list: list[int],
        model_identifier: str,
        normalization: str | None = None,
        metric: str = "squared",
        seed: int = 1,
        max_steps: int = 100,
        starts: dict[int, list[list[float]]] | None = None,
    ) -> KMeansModel | None:
        """Fit every k and return the model with the best silhouette (the first on a tie); `metric` as in `get_silhouette_avg`."""
        best, best_value = None, None
        self.silhouettes = {}
        for k in k_list:
            start = (starts or {}).get(k)
            model = self.create_model(table, feature_names, k, f"{model_identifier}_k{k}", normalization, start, seed)
            value = model.estimate(max_steps).get_silhouette_avg(metric)
            self.silhouettes[k] = value
            session.logger.info("k-means with %d clusters scores %s", k, value)
            if value is not None and (best_value is None or value > best_value):
                best, best_value = model, value
        return best

    def load_model(self, model_name: str, table: DataFrame | str | None = None) -> KMeansModel:
        """A saved model; give its table to train on or to read assignments."""
        meta = self._saved().require(model_name)
        cells = self._saved().params(meta["id"]).collect()
        found = {kind: np.zeros((meta["k"], meta["d"])) for kind in ("current", "assigned_by")}
        for c in cells:
            found[c.kind][c.j, c.l] = c.value
        frame = None if table is None else session.as_frame(self.spark, table)
        model = KMeansModel(
            self.spark, frame, meta["features"], [tuple(s) for s in meta["scales"]], found["current"], meta["n"],
            meta["name"], meta["normalization"], self.registry, meta["id"],
        )
        model.assigned_by = found["assigned_by"]
        model.steps, model.variance = meta["steps"], meta["variance"]
        return model

    def drop_model(self, model_name: str) -> None:
        self._saved().drop(model_name)

    def get_model_names(self) -> list[str]:
        return [m["name"] for m in self._saved().entries()]

    def _saved(self) -> ModelRegistry:
        if self.registry is None:
            raise RuntimeError("saved models need a model_path")
        return self.registry
