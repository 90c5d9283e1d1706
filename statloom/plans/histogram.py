"""Multidimensional histograms: density, classification and feature ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import session
from statloom.functions import metrics
from statloom.operators.joins import BROADCAST_ROWS, lookup_join
from statloom.operators.moments import MAX_GROUPS
from statloom.operators.quantile import SINGLE_CHUNK_ROWS, Bucket, equal_frequency_buckets, equal_width_buckets, quantise
from statloom.operators.split import bernoulli_split

PREDICTION = "prediction"
EDGES = {"frequency": equal_frequency_buckets, "width": equal_width_buckets}


def bucket_name(feature: str) -> str:
    return f"q_{feature}"


def _pair(feature: str, value: Column, skip_null: bool) -> Column:
    return F.struct(F.lit(feature).alias("f"), value.alias("x"), F.lit(skip_null).alias("skip_null"))


def rank_features(
    df: DataFrame, categorical: list[str], numeric: list[str], bins: int, target: str, chunk_rows: int = SINGLE_CHUNK_ROWS
) -> DataFrame:
    """(f, mi): mutual information in bits with the target, after equal-frequency
    buckets for numeric features; greatest first."""
    buckets = equal_frequency_buckets(df, numeric, bins, chunk_rows)
    coded = quantise(df, buckets, {c: bucket_name(c) for c in numeric})
    pairs = [_pair(c, F.col(session.quoted(bucket_name(c))).cast("string"), True) for c in numeric]
    pairs += [_pair(c, F.col(session.quoted(c)), False) for c in categorical]
    counts = (
        coded.select(F.col(session.quoted(target)).alias("y"), F.inline(F.array(*pairs)))
        .where("x IS NOT NULL OR NOT skip_null")
        .groupBy("f", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    return metrics.mutual_information(counts).orderBy(F.desc("mi"), "f")


@dataclass
class HistogramModel:
    """Bucket edges, and counts per cell and class."""

    numeric: list[str]
    categorical: list[str]
    target: str
    bins: int
    buckets: dict[str, list[Bucket]]
    cells: DataFrame
    class_counts: list[tuple]
    spark: SparkSession

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.class_counts)

    @property
    def majority(self):
        """The most frequent class, the smallest on a tie."""
        return min(self.class_counts, key=lambda c: (-c[1], c[0]))[0]

    @property
    def keys(self) -> list[str]:
        return [bucket_name(c) for c in self.numeric] + self.categorical

    def edges(self) -> DataFrame:
        """(f, xq, mn, mx, next_mn, first_mn, last_mx, n): at most `bins` rows per feature."""
        rows = []
        for f in self.numeric:
            group = self.buckets[f]
            for b, after in zip(group, [*group[1:], None]):
                rows.append((f, b.xq, b.mn, b.mx, after.mn if after else None, group[0].mn, group[-1].mx, b.n))
        schema = "f string, xq int, mn double, mx double, next_mn double, first_mn double, last_mx double, n long"
        return session.small_frame(self.spark, rows, schema)

    def _edges_of(self, feature: str, prefix: str = "") -> DataFrame:
        """One feature's edges; the upper end of the last bucket is its own maximum."""
        return self.edges().where(F.col("f") == F.lit(feature)).select(
            F.col("xq").alias(bucket_name(feature)),
            F.col("mn").alias(f"{prefix}mn"),
            F.coalesce("next_mn", "mx").alias(f"{prefix}mx"),
        )

    def contingency(self) -> DataFrame:
        """Cells with their edges, nxy, n_y and the total."""
        out = self.cells
        for f in self.numeric:
            out = out.join(F.broadcast(self._edges_of(f, f"{f}_")), bucket_name(f), "left")
        totals = session.small_frame(self.spark, self.class_counts, self._class_schema())
        out = out.join(F.broadcast(totals), F.col("y").eqNullSafe(F.col("_y")), "left").drop("_y")
        return out.withColumn("n_all", F.lit(self.rows).cast("long"))

    def _class_schema(self) -> str:
        return f"_y {self.cells.schema['y'].dataType.simpleString()}, n_y long"

    def quantise(self, df: DataFrame) -> DataFrame:
        return quantise(df, self.buckets, {c: bucket_name(c) for c in self.numeric})

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the likeliest class of the row's cell, its joint probability and
        whether the cell was seen; unseen cells get the majority class."""
        (found,) = session.unused_names(df, ["_best"])
        best = self.cells.groupBy(*self.keys).agg(
            F.min_by(F.struct("y", "nxy"), F.struct(-F.col("nxy"), F.col("y"))).alias(found)
        )
        joined = lookup_join(self.quantise(df), best, self.keys, BROADCAST_ROWS)
        label = self.cells.schema["y"].dataType
        return (
            joined.withColumn("matched", F.col(found).isNotNull())
            .withColumn(PREDICTION, F.when(F.col("matched"), F.col(f"{found}.y")).otherwise(F.lit(self.majority).cast(label)))
            .withColumn("measure", F.col(f"{found}.nxy") / F.lit(self.rows))
            .drop(found)
        )

    def density(self, df: DataFrame, features: list[str] | None = None) -> DataFrame:
        """One row per input row and class seen in its cell, with the joint
        probability `measure`; a row in an unseen cell keeps NULLs. Cells are those of
        the chosen features, of all by default."""
        chosen = [*self.numeric, *self.categorical] if features is None else features
        for f in chosen:
            self._require(f, [*self.numeric, *self.categorical])
        keys = [bucket_name(f) if f in self.numeric else f for f in chosen]
        (seen,) = session.unused_names(df, ["_seen"])
        summed = self.cells if features is None else self.cells.groupBy(*keys, "y").agg(F.sum("nxy").alias("nxy"))
        each = summed.groupBy(*keys).agg(F.collect_list(F.struct(F.col("y").alias("y_"), "nxy")).alias(seen))
        joined = lookup_join(self.quantise(df), each, keys, BROADCAST_ROWS)
        columns = [session.quoted(c) for c in joined.columns if c != seen]
        return (
            joined.select(*columns, F.inline_outer(seen))
            .withColumn("measure", F.col("nxy") / F.lit(self.rows))
            .drop("nxy")
        )

    def density_numeric(self, feature: str) -> DataFrame:
        """1-D table of a numeric feature: bucket, edges, midpoint, label, class, p and p_given_y."""
        self._require(feature, self.numeric)
        q = bucket_name(feature)
        summed = self._summed([q]).join(F.broadcast(self._edges_of(feature)), q)
        return summed.select(F.col(session.quoted(q)).alias("xq"), *self._interval(q), "y", "p", "p_given_y")

    def density_categorical(self, feature: str) -> DataFrame:
        """1-D table of a categorical feature: value, class, p and p_given_y."""
        self._require(feature, self.categorical)
        return self._summed([feature]).select(F.col(session.quoted(feature)).alias("xc"), "y", "p", "p_given_y")

    def density_1d(self, feature: str) -> DataFrame:
        return self.density_numeric(feature) if feature in self.numeric else self.density_categorical(feature)

    def density_2d(self, numeric: str, categorical: str) -> DataFrame:
        """2-D table: bucket by category by class."""
        self._require(numeric, self.numeric)
        self._require(categorical, self.categorical)
        q = bucket_name(numeric)
        summed = self._summed([q, categorical]).join(F.broadcast(self._edges_of(numeric)), q)
        return summed.select(
            F.col(session.quoted(q)).alias("xq"),
            *self._interval(q),
            F.col(session.quoted(categorical)).alias("xc"),
            "y",
            "p",
            "p_given_y",
        )

    def _summed(self, keys: list[str]) -> DataFrame:
        totals = session.small_frame(self.spark, self.class_counts, self._class_schema())
        summed = self.cells.groupBy(*keys, "y").agg(F.sum("nxy").alias("_n"))
        joined = summed.join(F.broadcast(totals), F.col("y").eqNullSafe(F.col("_y")), "left")
        return joined.withColumn("p", F.col("_n") / F.lit(self.rows)).withColumn("p_given_y", F.col("_n") / F.col("n_y"))

    @staticmethod
    def _interval(q: str) -> list[Column]:
        label = F.concat(
            F.col(session.quoted(q)).cast("string"),
            F.lit(": ]"),
            F.col("mn").cast("string"),
            F.lit(","),
            F.col("mx").cast("string"),
            F.lit("]"),
        )
        return [F.col("mn"), F.col("mx"), ((F.col("mn") + F.col("mx")) / 2).alias("x_"), label.alias("bin")]

    @staticmethod
    def _require(feature: str, known: list[str]) -> None:
        if feature not in known:
            raise ValueError(f"feature {feature!r} is not one of {known}")

    def unpersist(self) -> None:
        self.cells.unpersist()


def fit_histogram(
    df: DataFrame, target: str, categorical: list[str], numeric: list[str] | None = None, bins: int = 50, edges: str = "frequency"
) -> HistogramModel:
    """Quantise by exact edges, of equal "frequency" or equal "width", and count per cell and class.

    Rows without a value in a numeric feature or in the target are left out;
    without a feature list every numeric column but the target is used.
    """
    if numeric is None:
        numeric = session.split_features(df, [target])[0]
    known = df.where(F.col(session.quoted(target)).isNotNull()).where(session.known([session.number(c) for c in numeric]))
    if edges not in EDGES:
        raise ValueError(f"edges must be one of {sorted(EDGES)}, not {edges!r}")
    buckets = EDGES[edges](known, numeric, bins)
    coded = quantise(known, buckets, {c: bucket_name(c) for c in numeric})
    keys = [bucket_name(c) for c in numeric] + categorical
    cells = (
        coded.select(F.col(session.quoted(target)).alias("y"), *[F.col(session.quoted(k)) for k in keys])
        .groupBy("y", *keys)
        .agg(F.count("*").alias("nxy"))
        .persist()
    )
    by_class = session.bounded_rows(cells.groupBy("y").agg(F.sum("nxy").alias("n")), MAX_GROUPS, "classes")
    counts = sorted((r.y, r.n) for r in by_class)
    return HistogramModel(numeric, list(categorical), target, bins, buckets, cells, counts, df.sparkSession)


class MultidimensionalHistogram:
    """Split, rank, estimate, predict and score."""

    def __init__(self, spark: SparkSession, table: DataFrame | str, target: str, ratio: float = 0.8, seed: int = 1):
        self.spark = spark
        self.table = session.as_frame(spark, table)
        self.target, self.ratio, self.seed = target, ratio, seed
        self.train: DataFrame | None = None
        self.evaluation: DataFrame | None = None
        self.model: HistogramModel | None = None
        self.predictions: DataFrame | None = None

    def train_test_split(self, id_col: str | None = None) -> "MultidimensionalHistogram":
        self.train, self.evaluation = bernoulli_split(self.table, self.ratio, self.seed, id_col)
        return self

    def rank(self, table_train: DataFrame | str | None, cat_features: list[str], num_features: list[str], bins: int) -> DataFrame:
        source = self._training() if table_train is None else session.as_frame(self.spark, table_train)
        return rank_features(source, cat_features, num_features, bins, self.target)

    def estimate(
        self, cat_features: list[str], bins: int = 50, num_features: list[str] | None = None, edges: str = "frequency"
    ) -> "MultidimensionalHistogram":
        self.model = fit_histogram(self._training(), self.target, cat_features, num_features, bins, edges)
        self.predictions = None
        return self

    def predict(self, evaluation: DataFrame | str | None = None) -> "MultidimensionalHistogram":
        self.predictions = self._fitted().predict(self._evaluated(evaluation))
        return self

    def density(self, evaluation: DataFrame | str | None = None, features: list[str] | None = None) -> DataFrame:
        return self._fitted().density(self._evaluated(evaluation), features)

    def accuracy(self) -> DataFrame:
        if self.predictions is None:
            raise RuntimeError("predict first")
        return metrics.accuracy(self.predictions, self.target, PREDICTION)

    def visualize1D(self, feature: str) -> DataFrame:
        """The data of the 1-D density chart."""
        return self._fitted().density_1d(feature)

    def visualize2D(self, num_feature: str, cat_feature: str) -> DataFrame:
        """The data of the 2-D density chart."""
        return self._fitted().density_2d(num_feature, cat_feature)

    def get_cat_feat(self) -> list[str]:
        return self._fitted().categorical

    def get_num_feat(self) -> list[str]:
        return self._fitted().numeric

    def _training(self) -> DataFrame:
        return self.table if self.train is None else self.train

    def _evaluated(self, table: DataFrame | str | None) -> DataFrame:
        if table is not None:
            return session.as_frame(self.spark, table)
        return self.table if self.evaluation is None else self.evaluation

    def _fitted(self) -> HistogramModel:
        if self.model is None:
            raise RuntimeError("estimate first")
        return self.model
