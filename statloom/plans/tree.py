"""Mutual-information decision trees: split scores, models and the classifier; `stored_tree` grows them.

A level counts (node, feature, value, class) for all its nodes at once and
scores every split in the same plan.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import session
from statloom.functions import metrics
from statloom.functions.scores import total, xlog2x
from statloom.operators.encode import ordinal
from statloom.operators.joins import lookup_join
from statloom.operators.quantile import bucket_index, equal_frequency_buckets, running_sums
from statloom.operators.split import bernoulli_split, exact_split
from statloom.sources.tables import write_text

CRITERIA = ("full", "partial")
EXPRESSION_NODES = 128
EXPRESSION_DEPTH = 24
MAX_CLASSES = 1_000
MI_DIGITS = 10
BROADCAST_NUMBERS = 2_000_000
PREDICTION = "prediction"


@dataclass
class Node:
    """A node; inner nodes send `feature <= threshold` (or `= level`) to the left."""

    node_id: int
    parent_id: int | None
    depth: int
    counts: list[int]
    mi: float | None = None
    feature: str | None = None
    categorical: bool = False
    threshold: float | None = None
    level: str | None = None
    null_left: bool = False
    left: int | None = None
    right: int | None = None

    @property
    def n(self) -> int:
        return sum(self.counts)

    @property
    def is_leaf(self) -> bool:
        return self.left is None


NODE_SCHEMA = (
    "node_id int, parent_id int, depth int, counts array<long>, mi double, feature string, "
    "categorical boolean, threshold double, level string, null_left boolean, left int, right int"
)


@dataclass
class TreeModel:
    """The nodes by id (root 1), the features and the class labels."""

    numeric: list[str]
    categorical: list[str]
    target: str
    classes: list[Any]
    label_type: T.DataType
    nodes: dict[int, Node] = field(default_factory=dict)

    def predicted(self, node: Node) -> Any:
        """The most frequent class of a node, the first on a tie."""
        return self.classes[max(range(len(self.classes)), key=lambda c: (node.counts[c], -c))]

    def _depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    def node_column(self) -> Column:
        """The id of the node a row ends in."""
        if self._is_small():
            return F.expr(self._nested_case(self.nodes[1], lambda n: str(n.node_id)))
        return self._node_by_batch()

    def _is_small(self) -> bool:
        inner = sum(not n.is_leaf for n in self.nodes.values())
        return inner <= EXPRESSION_NODES and self._depth() <= EXPRESSION_DEPTH

    def _nested_case(self, node: Node, leaf_value) -> str:
        """The tree as nested CASE text, so a row is tested along its own path only."""
        if node.is_leaf:
            return leaf_value(node)
        name = session.quoted(node.feature)
        if node.categorical:
            test = f"{name} = {_literal(node.level)}"
        else:
            test = f"{session.number_sql(node.feature)} <= {_literal(node.threshold)}"
        left, right = (self._nested_case(self.nodes[i], leaf_value) for i in (node.left, node.right))
        return f"CASE WHEN coalesce({test}, {str(node.null_left).lower()}) THEN {left} ELSE {right} END"

    def _node_by_batch(self) -> Column:
        """Whole Arrow batches walk down the tree together."""
        size = max(self.nodes) + 1
        place = {**{c: i for i, c in enumerate(self.numeric)}, **{c: i for i, c in enumerate(self.categorical)}}
        feature, left, right = (np.zeros(size, dtype=int) for _ in range(3))
        threshold, inner = np.zeros(size), np.zeros(size, dtype=bool)
        categorical, null_left = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        level = np.full(size, None, dtype=object)
        for i, n in self.nodes.items():
            if not n.is_leaf:
                feature[i], left[i], right[i], inner[i] = place[n.feature], n.left, n.right, True
                categorical[i], null_left[i], level[i] = n.categorical, n.null_left, n.level
                threshold[i] = n.threshold if n.threshold is not None else 0.0
        width, names = len(self.numeric), len(self.categorical)

        @F.pandas_udf("int")
        def walk(numbers: pd.Series, texts: pd.Series) -> pd.Series:
            rows = len(numbers)
            x = np.array([np.asarray(v, dtype=float) for v in numbers]).reshape(rows, width)
            t = np.array([list(v) for v in texts], dtype=object).reshape(rows, names)
            at = np.ones(rows, dtype=int)
            active = np.flatnonzero(inner[at])
            while len(active):
                node = at[active]
                go = np.zeros(len(active), dtype=bool)
                texted = categorical[node]
                if texted.any():
                    value = t[active[texted], feature[node[texted]]]
                    missing = np.array([v is None for v in value])
                    go[texted] = np.where(missing, null_left[node[texted]], value == level[node[texted]])
                if (~texted).any():
                    value = x[active[~texted], feature[node[~texted]]]
                    go[~texted] = np.where(np.isnan(value), null_left[node[~texted]], value <= threshold[node[~texted]])
                at[active] = np.where(go, left[node], right[node])
                active = active[inner[at[active]]]
            return pd.Series(at.astype("int32"))

        numbers = F.array(*[session.number(c) for c in self.numeric]).cast("array<double>")
        texts = F.array(*[F.col(session.quoted(c)) for c in self.categorical]).cast("array<string>")
        return walk(numbers, texts)

    def transform(self, df: DataFrame, output: str = PREDICTION) -> DataFrame:
        """Add the predicted class, as a column expression."""
        known = F.array(*[F.lit(c).cast(self.label_type) for c in self.classes])
        place = {label: c for c, label in enumerate(self.classes)}
        if self._is_small():
            at = F.expr(self._nested_case(self.nodes[1], lambda n: str(place[self.predicted(n)])))
            return df.withColumn(output, F.get(known, at))
        by_node = [0] * (max(self.nodes) + 1)
        for n in self.nodes.values():
            by_node[n.node_id] = place[self.predicted(n)]
        return df.withColumn(output, F.get(known, _looked_up(by_node)(self.node_column())))

    def case_text(self) -> str:
        """The tree as SQL text: one WHEN per leaf."""
        lines = ["CASE"]
        pending = deque([(self.nodes[1], [])])
        while pending:
            node, path = pending.popleft()
            if node.is_leaf:
                lines.append(f"WHEN {' AND '.join(path) or 'TRUE'} THEN {_literal(self.predicted(node))}")
                continue
            name = session.quoted(node.feature)
            if node.categorical:
                test = f"{name} = {_literal(node.level)}"
            else:
                test = f"{session.number_sql(node.feature)} <= {_literal(node.threshold)}"
            test = f"coalesce({test}, {str(node.null_left).lower()})"
            pending.append((self.nodes[node.left], [*path, test]))
            pending.append((self.nodes[node.right], [*path, f"NOT {test}"]))
        return "\n".join([*lines, "ELSE NULL", "END"])

    def create_function(self, spark: SparkSession, name: str) -> str:
        """Register the tree as a temporary SQL function of its features."""
        arguments = [f"{session.quoted(c)} DOUBLE" for c in self.numeric]
        arguments += [f"{session.quoted(c)} STRING" for c in self.categorical]
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {session.quoted(name)}({', '.join(arguments)}) "
            f"RETURNS {self.label_type.simpleString()} RETURN {self.case_text()}"
        )
        return name

    def node_table(self, spark: SparkSession) -> DataFrame:
        """What a drawing of the tree would show, one row per node."""
        rows = []
        for n in sorted(self.nodes.values(), key=lambda n: n.node_id):
            left = self.nodes[n.left].n if not n.is_leaf else None
            right = self.nodes[n.right].n if not n.is_leaf else None
            op = None if n.is_leaf else "=" if n.categorical else "<="
            rows.append(
                (n.node_id, n.parent_id, n.depth, n.feature, op, n.threshold, n.level, n.mi, n.n, left, right, n.is_leaf, self.predicted(n))
            )
        schema = T.StructType.fromDDL(
            "node_id int, parent_id int, depth int, feature string, op string, threshold double, level string, "
            "mi double, n long, n_left long, n_right long, is_leaf boolean"
        ).add(PREDICTION, self.label_type)
        return session.small_frame(spark, rows, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (n.node_id, n.parent_id, n.depth, n.counts, n.mi, n.feature, n.categorical, n.threshold, n.level, n.null_left, n.left, n.right)
            for n in self.nodes.values()
        ]
        session.small_frame(spark, rows, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        about = T.StructType.fromDDL("target string, numeric array<string>, categorical array<string>").add(
            "classes", T.ArrayType(self.label_type)
        )
        session.small_frame(spark, [(self.target, self.numeric, self.categorical, self.classes)], about).write.mode(
            "overwrite"
        ).parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        about = spark.read.parquet(f"{path}/about")
        row = about.first()
        nodes = {r.node_id: Node(**r.asDict()) for r in spark.read.parquet(f"{path}/nodes").collect()}
        label_type = about.schema["classes"].dataType.elementType
        return TreeModel(list(row.numeric), list(row.categorical), row.target, list(row.classes), label_type, nodes)


def _looked_up(values: list[int]):
    table = np.array(values, dtype="int32")

    @F.pandas_udf("int")
    def find(at: pd.Series) -> pd.Series:
        return pd.Series(table[at.to_numpy()])

    return find


def _literal(value: Any) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def prepare(df: DataFrame, target: str, classes: list[Any], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Features and the class number `_y`; rows without a target are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(session.quoted(target)))
    return df.where(place > 0).select(
        *[session.number(c).alias(c) for c in numeric],
        *[F.col(session.quoted(c)) for c in categorical],
        (place - 1).cast("int").alias("_y"),
    )


def class_labels(df: DataFrame, target: str) -> list[Any]:
    """Sorted distinct target values."""
    found = df.select(F.col(session.quoted(target)).alias("y")).dropna().distinct()
    return sorted(r.y for r in session.bounded_rows(found, MAX_CLASSES, "classes"))


def value_counts(data: DataFrame, features: list[str], number_of_classes: int, chunks: dict[str, str] | None = None) -> DataFrame:
    """(node, f, x[, chunk], n0..): rows per node, feature, value and class.

    Partial sums collapse each task's copies before anything is shuffled.
    """
    parts = [
        F.struct(
            F.lit(i).alias("f"),
            F.col(session.quoted(c)).alias("x"),
            *([F.col(chunks[c]).alias("chunk")] if chunks else []),
        )
        for i, c in enumerate(features)
    ]
    keys = ["node", "f", "x", *(["chunk"] if chunks else [])]
    return (
        data.select("node", "_y", F.inline(F.array(*parts)))
        .where("x IS NOT NULL")
        .groupBy(*keys)
        .agg(*[F.expr(f"count_if(_y = {c}) AS n{c}") for c in range(number_of_classes)])
    )


def split_score(left: list[str], whole: list[str], here: list[str], criterion: str) -> str:
    """Mutual information of a split with the class in bits, as SQL text.

    "full" takes both sides and all classes. "partial" adds the left side's
    terms only, for the classes that occur at the very value.
    """
    if criterion == "partial":
        terms = [
            f"IF({h} > 0, {l} / n * log2(try_divide({l} / n, ({w} / n) * (n_left / n))), 0D)"
            for l, w, h in zip(left, whole, here)
        ]
        return total(terms)
    sides = [xlog2x(l) for l in left] + [xlog2x(f"({w} - {l})") for l, w in zip(left, whole)]
    classes = total([xlog2x(w) for w in whole])
    return f"({total(sides)} - {xlog2x('n_left')} - {xlog2x('(n - n_left)')} - {classes} + {xlog2x('n')}) / n"


def numeric_scores(counts: DataFrame, classes: int, criterion: str, chunked: bool) -> DataFrame:
    """(node, f, x, mi, n_left, n, left, whole) of every threshold `<= x`."""
    names = [f"n{c}" for c in range(classes)]
    summed = running_sums(counts, ["node", "f"], "x", names, "chunk" if chunked else None)
    return _scored(summed, [f"cum_{v}" for v in names], [f"tot_{v}" for v in names], names, criterion)


def categorical_scores(counts: DataFrame, classes: int, criterion: str, groups: int) -> DataFrame:
    """(node, f, x, mi, n_left, n, left, whole) of every split `= x`; `groups` bounds (node, f)."""
    names = [f"n{c}" for c in range(classes)]
    sums = counts.groupBy("node", "f").agg(*[F.expr(f"sum({v}) AS tot_{v}") for v in names])
    if groups * classes <= BROADCAST_NUMBERS:
        joined = counts.join(F.broadcast(sums), ["node", "f"])
    else:
        joined = lookup_join(counts, sums, ["node", "f"])
    return _scored(joined, names, [f"tot_{v}" for v in names], names, criterion)


def _scored(df: DataFrame, left: list[str], whole: list[str], here: list[str], criterion: str) -> DataFrame:
    sizes = df.selectExpr("*", f"{total(left)} AS n_left", f"{total(whole)} AS n")
    return sizes.selectExpr(
        "node",
        "f",
        "x",
        f"{split_score(left, whole, here, criterion)} AS mi",
        "n_left",
        "n",
        f"array({', '.join(left)}) AS left",
        f"array({', '.join(whole)}) AS whole",
    )


def best_splits(scored: DataFrame) -> DataFrame:
    """Per node, the split of greatest information with rows on both sides;
    ties go to the first feature, then to the smallest value."""
    chosen = F.expr(f"min_by(struct(f, x, mi, left, whole), struct(-round(mi, {MI_DIGITS}), f, x)) AS s")
    return scored.where("n_left < n").groupBy("node").agg(chosen).select("node", "s.*")


def grow_tree(df: DataFrame, target: str, numeric: list[str], categorical: list[str] | None = None, classes: list[Any] | None = None, **options) -> TreeModel:
    """Grow a tree and hold it as one object; see `stored_tree.grow` for the options and for trees too large for that."""
    from statloom.plans import stored_tree

    return stored_tree.grow(df, target, numeric, categorical, classes, **options).model()


def binned(data: DataFrame, numeric: list[str], bins: int) -> DataFrame:
    """Each numeric value replaced by the greatest value of its bucket."""
    buckets = equal_frequency_buckets(data, numeric, bins)
    index = {c: f"_bucket_{i}" for i, c in enumerate(numeric)}
    placed = bucket_index(data, {c: [b.mn for b in buckets[c][1:]] for c in numeric}, index)
    ends = {
        c: F.get(F.array(*[F.lit(b.mx) for b in buckets[c]]), F.col(index[c])) if buckets[c] else F.lit(None).cast("double")
        for c in numeric
    }
    kept = [F.col(session.quoted(c)) for c in data.columns if c not in numeric]
    return placed.select(*[ends[c].alias(c) for c in numeric], *kept)


class DecisionTreeClassifier:
    """Initialise, split, estimate, predict and score."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.dataset: DataFrame | None = None
        self.train: DataFrame | None = None
        self.evaluation: DataFrame | None = None
        self.predictions: DataFrame | None = None
        self.model: TreeModel | None = None
        self.stored = None
        self.name = "dataset"
        self.target = ""
        self.target_classes: list[Any] = []
        self.numeric: list[str] = []
        self.categorical: list[str] = []

    def initialize(
        self,
        dataset: DataFrame | str,
        target: str = "",
        target_classes: list[Any] | None = None,
        table_train: DataFrame | str | None = None,
        table_eval: DataFrame | str | None = None,
        features: list[str] | None = None,
    ) -> "DecisionTreeClassifier":
        """Default target: the last column; default classes: its sorted values."""
        self.dataset = session.as_frame(self.spark, dataset)
        self.name = dataset if isinstance(dataset, str) else "dataset"
        self.target = target or self.dataset.columns[-1]
        self.train = None if table_train is None else session.as_frame(self.spark, table_train)
        self.evaluation = None if table_eval is None else session.as_frame(self.spark, table_eval)
        self.target_classes = class_labels(self.dataset, self.target) if target_classes is None else list(target_classes)
        numeric, categorical = session.split_features(self.dataset, [self.target])
        self.numeric = [c for c in numeric if features is None or c in features]
        self.categorical = [c for c in categorical if features is None or c in features]
        self.model = self.stored = self.predictions = None
        return self

    def train_test_split(
        self, ratio: float = 0.8, seed: int = 1, encode: bool = False, id_col: str | None = None, exact: bool = False
    ) -> "DecisionTreeClassifier":
        """Seeded split; `encode` turns categories into ordinals, `exact` fixes the size."""
        source = self._given()
        if encode and self.categorical:
            source = ordinal(source, self.categorical)
            self.numeric, self.categorical = [*self.numeric, *self.categorical], []
        if exact:
            if id_col is None:
                raise ValueError("an exact split needs an id column")
            self.train, self.evaluation = exact_split(source, id_col, ratio, seed)
        else:
            self.train, self.evaluation = bernoulli_split(source, ratio, seed, id_col)
        return self

    def estimate(self, max_samples: int = 2, max_mutual_inf: float = 0.0, **options) -> "DecisionTreeClassifier":
        source = self.train if self.train is not None else self._given()
        from statloom.plans import stored_tree

        self.stored = stored_tree.grow(
            source, self.target, self.numeric, self.categorical, self.target_classes, max_samples, max_mutual_inf, **options
        )
        self.model = self.predictions = None
        return self

    def create_model(self, file_output: str | None = None) -> str:
        """The tree as CASE text, also written out when a path is given."""
        text = self._fitted().case_text()
        if file_output is not None:
            write_text(self.spark, text, file_output)
        return text

    def predict_table(self, stored_procedure: bool = False) -> DataFrame:
        """The evaluation rows with their prediction; optionally also a SQL function."""
        if stored_procedure:
            self._fitted().create_function(self.spark, f"predict_{self.name}")
        return self.predict()

    def predict(self, table: DataFrame | str | None = None) -> DataFrame:
        if table is not None:
            source = session.as_frame(self.spark, table)
        else:
            source = self.evaluation if self.evaluation is not None else self._given()
        fitted = self.stored if self.stored is not None else self._fitted()
        self.predictions = fitted.transform(source)
        return self.predictions

    def score(self) -> float:
        if self.predictions is None:
            self.predict()
        return metrics.accuracy(self.predictions, self.target, PREDICTION).first()["accuracy"]

    def visualize_tree(self) -> DataFrame:
        return self._fitted().node_table(self.spark)

    def save_dtc_tree(self, path: str) -> None:
        self._fitted().save(self.spark, path)

    def read_dtc_tree(self, path: str) -> "DecisionTreeClassifier":
        self.model, self.stored = TreeModel.load(self.spark, path), None
        self.target, self.target_classes = self.model.target, self.model.classes
        self.numeric, self.categorical = self.model.numeric, self.model.categorical
        return self

    def _given(self) -> DataFrame:
        if self.dataset is None:
            raise RuntimeError("initialize first")
        return self.dataset

    def _fitted(self) -> TreeModel:
        if self.model is None:
            if self.stored is None:
                raise RuntimeError("estimate first")
            self.model = self.stored.model()
        return self.model
