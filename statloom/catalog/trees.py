"""Counts, split scores, level-wise trees and tree predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import load, rounded
from statloom.functions.metrics import accuracy
from statloom.plans import stored_tree
from statloom.plans.tree import (
    DecisionTreeClassifier,
    TreeModel,
    best_splits,
    categorical_scores,
    class_labels,
    grow_tree,
    numeric_scores,
    prepare,
    value_counts,
)
from statloom.session import shared_folder, small_frame

NUMERIC = ["l_quantity", "l_discount", "l_tax"]
CATEGORICAL = ["l_linestatus"]
TARGET = "l_returnflag"
CLASSES = ["A", "N", "R"]


def _root(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    lineitem = load(spark, d, "lineitem")
    labels = class_labels(lineitem, TARGET)
    return prepare(lineitem, TARGET, labels, NUMERIC, CATEGORICAL).withColumn("node", F.lit(1)), labels


def _named(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("f", F.get(F.array(*[F.lit(c) for c in features]), F.col("f")))


def _grown(spark: SparkSession, d: str, **options) -> tuple[DataFrame, TreeModel]:
    lineitem = load(spark, d, "lineitem")
    return lineitem, grow_tree(lineitem, TARGET, NUMERIC, CATEGORICAL, max_depth=2, **options)


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per feature, value and class."""
    data, labels = _root(spark, d)
    found = value_counts(data, NUMERIC, len(labels))
    per_class = [F.struct(F.lit(y).alias("y"), F.col(f"n{c}").alias("nxy")) for c, y in enumerate(labels)]
    return _named(found, NUMERIC).select("f", "x", F.inline(F.array(*per_class))).where("nxy > 0")


def numeric(spark: SparkSession, d: str) -> DataFrame:
    """Information of every threshold of every numeric feature."""
    data, labels = _root(spark, d)
    found = numeric_scores(value_counts(data, NUMERIC, len(labels)), len(labels), "full", False)
    return rounded(_named(found, NUMERIC).select("f", "x", "mi"), mi=10)


def numeric_partial(spark: SparkSession, d: str) -> DataFrame:
    """The one-sided score of every threshold."""
    data, labels = _root(spark, d)
    found = numeric_scores(value_counts(data, NUMERIC, len(labels)), len(labels), "partial", False)
    return rounded(_named(found, NUMERIC).select("f", "x", "mi"), mi=10)


def categorical(spark: SparkSession, d: str) -> DataFrame:
    """Information of every `= value` split of the order priority."""
    orders = load(spark, d, "orders")
    labels = class_labels(orders, "o_orderstatus")
    data = prepare(orders, "o_orderstatus", labels, [], ["o_orderpriority"]).withColumn("node", F.lit(1))
    found = categorical_scores(value_counts(data, ["o_orderpriority"], len(labels)), len(labels), "full", 1)
    return rounded(found.select("x", "mi"), mi=10)


def categorical_partial(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    labels = class_labels(orders, "o_orderstatus")
    data = prepare(orders, "o_orderstatus", labels, [], ["o_orderpriority"]).withColumn("node", F.lit(1))
    found = categorical_scores(value_counts(data, ["o_orderpriority"], len(labels)), len(labels), "partial", 1)
    return rounded(found.select("x", "mi"), mi=10)


def best(spark: SparkSession, d: str) -> DataFrame:
    data, labels = _root(spark, d)
    found = best_splits(numeric_scores(value_counts(data, NUMERIC, len(labels)), len(labels), "full", False))
    return rounded(_named(found, NUMERIC).select("f", "x", "mi"), mi=10)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree of two levels, node by node."""
    _, model = _grown(spark, d)
    return rounded(model.node_table(spark).fillna(0, ["parent_id", "n_left", "n_right"]), mi=10)


def predict(spark: SparkSession, d: str) -> DataFrame:
    lineitem, model = _grown(spark, d)
    return model.transform(lineitem).groupBy(TARGET, "prediction").agg(F.count("*").alias("n"))


def score(spark: SparkSession, d: str) -> DataFrame:
    lineitem, model = _grown(spark, d)
    return rounded(accuracy(model.transform(lineitem), TARGET, "prediction"), accuracy=10)


def sql_function(spark: SparkSession, d: str) -> DataFrame:
    """The same tree called as a SQL function."""
    lineitem, model = _grown(spark, d)
    name = model.create_function(spark, "predict_lineitem")
    called = F.expr(f"{name}({', '.join([*NUMERIC, *CATEGORICAL])})")
    return lineitem.select(TARGET, called.alias("prediction")).groupBy(TARGET, "prediction").agg(F.count("*").alias("n"))


def binned(spark: SparkSession, d: str) -> DataFrame:
    """The first split when thresholds are bucket ends of many-valued prices."""
    orders = load(spark, d, "orders")
    model = grow_tree(orders, "o_orderstatus", ["o_totalprice"], [], max_depth=1, max_bins=20)
    root = model.nodes[1]
    row = [(root.feature, root.threshold, root.mi, model.nodes[root.left].n, model.nodes[root.right].n)]
    return rounded(small_frame(spark, row, "f string, x double, mi double, n_left long, n_right long"), mi=10)


def many_valued(spark: SparkSession, d: str) -> DataFrame:
    """The first split over every distinct order price, summed in chunks."""
    orders = load(spark, d, "orders")
    model = grow_tree(orders, "o_orderstatus", ["o_totalprice"], [], max_depth=1, chunk_rows=5_000, local_rows=0)
    root = model.nodes[1]
    row = [(root.feature, root.threshold, root.mi, model.nodes[root.left].n, model.nodes[root.right].n)]
    return rounded(small_frame(spark, row, "f string, x double, mi double, n_left long, n_right long"), mi=10)


def stopped_early(spark: SparkSession, d: str) -> DataFrame:
    """Part types by brand and size until the stopping rules hold; rows per leaf class."""
    part = load(spark, d, "part")
    model = grow_tree(part, "p_type", ["p_size"], ["p_brand"], max_samples=200, max_mutual_inf=0.0005)
    return model.transform(part).groupBy("p_type", "prediction").agg(F.count("*").alias("n"))


def full(spark: SparkSession, d: str) -> DataFrame:
    """A tree that ends only where no split helps; rows by the depth and class of their leaf."""
    part = load(spark, d, "part")
    tree = stored_tree.grow(part, "p_type", ["p_size", "p_retailprice"], ["p_brand"])
    rows = tree.routed(part, depth_output="depth")
    return rows.groupBy("depth", "prediction").agg(F.count("*").alias("n"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    """The stopped tree kept in tables, its upper nodes grown by levels, used by joins only."""
    part = load(spark, d, "part")
    stored = stored_tree.grow(part, "p_type", ["p_size"], ["p_brand"], max_samples=200, max_mutual_inf=0.0005, local_rows=1_800)
    return stored.routed(part).select("p_partkey", "prediction")


def saved(spark: SparkSession, d: str) -> DataFrame:
    """A classifier with the default target, its last column, saved, read again and used."""
    part = load(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4()}"
    tree = DecisionTreeClassifier(spark).initialize(part, features=["p_size", "p_brand"])
    tree.estimate(max_samples=200, max_mutual_inf=0.0005).save_dtc_tree(path)
    found = DecisionTreeClassifier(spark).read_dtc_tree(path).predict(part)
    return found.groupBy("p_type", "prediction").agg(F.count("*").alias("n"))


def _x(value: str) -> str:
    return f"(CASE WHEN {value} > 0 THEN {value} * log2({value}) ELSE 0 END)"


def _mi(left: list[str], whole: list[str]) -> str:
    """Information of a two-way split from class counts, as SQL."""
    right = [f"({w} - {l})" for l, w in zip(left, whole)]
    n, nl = f"({' + '.join(whole)})", f"({' + '.join(left)})"
    sides = " + ".join(_x(v) for v in [*left, *right])
    classes = " + ".join(_x(w) for w in whole)
    return f"(({sides}) - {_x(nl)} - {_x(f'({n} - {nl})')} - ({classes}) + {_x(n)}) / {n}"


def _partial(left: list[str], whole: list[str], here: list[str]) -> str:
    n, nl = f"({' + '.join(whole)})", f"({' + '.join(left)})"
    return " + ".join(
        f"CASE WHEN {h} > 0 THEN {l} / {n} * log2(({l} / {n}) / (({w} / {n}) * ({nl} / {n}))) ELSE 0 END"
        for l, w, h in zip(left, whole, here)
    )


_L, _W, _H = ["l0", "l1", "l2"], ["w0", "w1", "w2"], ["n0", "n1", "n2"]


def _class_counts(target: str, classes: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {target} = '{c}') AS n{i}" for i, c in enumerate(classes))


def _scores(rows: str, numeric_x: list[str], categorical_x: list[str], target: str, classes: list[str], tag: str = "") -> str:
    """CTE s<tag>(node, place, f, x, v, mi, l*, w*) of every split of every node of `rows`."""
    n = _class_counts(target, classes)
    num = " UNION ALL ".join(
        f"SELECT node, {i} AS place, '{c}' AS f, CAST({c} AS DOUBLE) AS x, NULL::VARCHAR AS v, {n} FROM {rows} GROUP BY node, {c}"
        for i, c in enumerate(numeric_x)
    )
    cat = " UNION ALL ".join(
        f"SELECT node, {len(numeric_x) + i} AS place, '{c}' AS f, NULL::DOUBLE AS x, {c} AS v, {n} FROM {rows} GROUP BY node, {c}"
        for i, c in enumerate(categorical_x)
    )
    parts = []
    if num:
        cum = ", ".join(f"sum(n{i}) OVER (PARTITION BY node, f ORDER BY x) AS l{i}" for i in range(len(classes)))
        tot = ", ".join(f"sum(n{i}) OVER (PARTITION BY node, f) AS w{i}" for i in range(len(classes)))
        parts.append(f"SELECT *, {cum}, {tot} FROM ({num})")
    if cat:
        same = ", ".join(f"n{i} AS l{i}" for i in range(len(classes)))
        tot = ", ".join(f"sum(n{i}) OVER (PARTITION BY node, f) AS w{i}" for i in range(len(classes)))
        parts.append(f"SELECT *, {same}, {tot} FROM ({cat})")
    left, whole = ([f"{side}{i}" for i in range(len(classes))] for side in "lw")
    return f"u{tag} AS ({' UNION ALL '.join(parts)}), s{tag} AS (SELECT *, {_mi(left, whole)} AS mi FROM u{tag})"


def _best(scored: str, classes: int = 3) -> str:
    left, whole = (" + ".join(f"{side}{i}" for i in range(classes)) for side in "lw")
    return (
        f"SELECT * FROM {scored} WHERE {left} < {whole} QUALIFY row_number() OVER "
        "(PARTITION BY node ORDER BY round(mi, 10) DESC, place, x, v) = 1"
    )


def _to_the_end(table: str, key: str, numeric_x: list[str], categorical_x: list[str], target: str, classes: list[str], least: int, information: float) -> str:
    """Recursive CTE t: the rows of every node of a tree, a node being its path of sides; then last: the last node of each row and its class."""
    whole = [f"w{i}" for i in range(len(classes))]
    kinds = " + ".join(f"CAST({w} > 0 AS INT)" for w in whole)
    open_ = f"{' + '.join(whole)} >= {least} AND {kinds} > 1 AND mi >= {information} AND round(mi, 10) > 0"
    names = [key, target, *numeric_x, *categorical_x]
    step = (
        f"WITH {_scores('t', numeric_x, categorical_x, target, classes)}, b AS (SELECT node, f, x, v FROM ({_best('s', len(classes))}) WHERE {open_}) "
        f"SELECT depth + 1 AS depth, t.node || CASE WHEN {_goes_left(numeric_x, categorical_x)} THEN 'l' ELSE 'r' END AS node, "
        f"{', '.join('t.' + c for c in names)} FROM t JOIN b ON t.node = b.node"
    )
    first = " ".join(f"WHEN n{i} = greatest({', '.join(f'n{j}' for j in range(len(classes)))}) THEN '{c}'" for i, c in enumerate(classes))
    return (
        f"RECURSIVE t AS (SELECT 0 AS depth, '' AS node, {', '.join(names)} FROM {table} UNION ALL ({step})), "
        f"labels AS (SELECT node, CASE {first} END AS prediction FROM (SELECT node, {_class_counts(target, classes)} FROM t GROUP BY node)), "
        f"last AS (SELECT {key}, {target}, arg_max(node, depth) AS node FROM t GROUP BY ALL)"
    )


def _goes_left(numeric_x: list[str], categorical_x: list[str]) -> str:
    tests = [f"WHEN f = '{c}' THEN {c} <= x" for c in numeric_x] + [f"WHEN f = '{c}' THEN {c} = v" for c in categorical_x]
    return f"(CASE {' '.join(tests)} END)"


_ROOT = "r0 AS (SELECT 1 AS node, * FROM lineitem)"
_GROW = (
    f"{_ROOT}, {_scores('r0', NUMERIC, CATEGORICAL, TARGET, CLASSES, '1')}, b1 AS ({_best('s1')}), "
    f"r1 AS (SELECT 2 * r0.node + CASE WHEN {_goes_left(NUMERIC, CATEGORICAL)} THEN 0 ELSE 1 END AS node, r0.* EXCLUDE (node) "
    "FROM r0 JOIN b1 USING (node)), "
    f"{_scores('r1', NUMERIC, CATEGORICAL, TARGET, CLASSES, '2')}, b2 AS ({_best('s2')}), "
    f"r2 AS (SELECT 2 * r1.node + CASE WHEN {_goes_left(NUMERIC, CATEGORICAL)} THEN 0 ELSE 1 END AS node, r1.* EXCLUDE (node) "
    "FROM r1 JOIN b2 USING (node)), "
    f"k AS (SELECT node, count(*) AS n, {_class_counts(TARGET, CLASSES)} FROM "
    f"(SELECT node, {TARGET} FROM r0 UNION ALL SELECT node, {TARGET} FROM r1 UNION ALL SELECT node, {TARGET} FROM r2) GROUP BY node), "
    "y AS (SELECT *, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 'A' WHEN n1 >= n2 THEN 'N' ELSE 'R' END AS prediction FROM k)"
)
_CONFUSION = (
    f"WITH {_GROW} SELECT {TARGET}, prediction, count(*) AS n FROM r2 JOIN y USING (node) GROUP BY ALL"
)
_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_STOPPED = _to_the_end("part", "p_partkey", ["p_size"], ["p_brand"], "p_type", _PART_TYPES, 200, 0.0005)
_FULL = _to_the_end("part", "p_partkey", ["p_size", "p_retailprice"], ["p_brand"], "p_type", _PART_TYPES, 2, 0.0)
_ORDERS = "o AS (SELECT 1 AS node, * FROM orders)"
_STATUS = ["F", "O", "P"]

QUERIES = {
    "tree_counts": counts,
    "tree_numeric_scores": numeric,
    "tree_numeric_scores_partial": numeric_partial,
    "tree_categorical_scores": categorical,
    "tree_categorical_scores_partial": categorical_partial,
    "tree_best_split": best,
    "tree_nodes": nodes,
    "tree_predict": predict,
    "tree_accuracy": score,
    "tree_sql_function": sql_function,
    "tree_binned_split": binned,
    "tree_many_valued_split": many_valued,
    "tree_stopped_early": stopped_early,
    "tree_full": full,
    "tree_routed_by_joins": routed,
    "tree_saved_predict": saved,
}

ORACLES = {
    "tree_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS f, {c} AS x, {TARGET} AS y, count(*) AS nxy FROM lineitem GROUP BY ALL" for c in NUMERIC
    ),
    "tree_numeric_scores": (
        f"WITH {_ROOT}, {_scores('r0', NUMERIC, [], TARGET, CLASSES)} SELECT f, x, round(mi, 10) AS mi FROM s"
    ),
    "tree_numeric_scores_partial": (
        f"WITH {_ROOT}, {_scores('r0', NUMERIC, [], TARGET, CLASSES)} SELECT f, x, round({_partial(_L, _W, _H)}, 10) AS mi FROM u"
    ),
    "tree_categorical_scores": (
        f"WITH {_ORDERS}, {_scores('o', [], ['o_orderpriority'], 'o_orderstatus', _STATUS)} SELECT v AS x, round(mi, 10) AS mi FROM s"
    ),
    "tree_categorical_scores_partial": (
        f"WITH {_ORDERS}, {_scores('o', [], ['o_orderpriority'], 'o_orderstatus', _STATUS)} "
        f"SELECT v AS x, round({_partial(_L, _W, _H)}, 10) AS mi FROM u"
    ),
    "tree_best_split": (
        f"WITH {_ROOT}, {_scores('r0', NUMERIC, [], TARGET, CLASSES)}, b AS ({_best('s')}) SELECT f, x, round(mi, 10) AS mi FROM b"
    ),
    "tree_nodes": (
        f"WITH {_GROW}, b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2) "
        "SELECT CAST(y.node AS INT) AS node_id, CAST(y.node // 2 AS INT) AS parent_id, "
        "CAST(floor(log2(y.node)) AS INT) AS depth, f AS feature, CASE WHEN v IS NOT NULL THEN '=' WHEN x IS NOT NULL THEN '<=' END AS op, "
        "x AS threshold, v AS level, round(mi, 10) AS mi, y.n, CAST(coalesce(l0 + l1 + l2, 0) AS BIGINT) AS n_left, "
        "CAST(coalesce(w0 + w1 + w2 - l0 - l1 - l2, 0) AS BIGINT) AS n_right, f IS NULL AS is_leaf, prediction "
        "FROM y LEFT JOIN b ON b.node = y.node"
    ),
    "tree_predict": _CONFUSION,
    "tree_sql_function": _CONFUSION,
    "tree_accuracy": (
        f"WITH {_GROW} SELECT count(*) AS cases, CAST(sum(CAST({TARGET} = prediction AS INT)) AS BIGINT) AS tp, "
        f"round(avg(CAST({TARGET} = prediction AS INT)), 10) AS accuracy FROM r2 JOIN y USING (node)"
    ),
    "tree_binned_split": (
        "WITH q AS (SELECT *, (20 * rank() OVER (ORDER BY o_totalprice) + count(*) OVER () - 1) // count(*) OVER () AS b FROM orders), "
        "o AS (SELECT 1 AS node, o_orderstatus, max(o_totalprice) OVER (PARTITION BY b) AS o_totalprice FROM q), "
        f"{_scores('o', ['o_totalprice'], [], 'o_orderstatus', _STATUS)}, b AS ({_best('s')}) "
        "SELECT f, x, round(mi, 10) AS mi, CAST(l0 + l1 + l2 AS BIGINT) AS n_left, CAST(w0 + w1 + w2 - l0 - l1 - l2 AS BIGINT) AS n_right FROM b"
    ),
    "tree_many_valued_split": (
        f"WITH {_ORDERS}, {_scores('o', ['o_totalprice'], [], 'o_orderstatus', _STATUS)}, b AS ({_best('s')}) "
        "SELECT f, x, round(mi, 10) AS mi, CAST(l0 + l1 + l2 AS BIGINT) AS n_left, CAST(w0 + w1 + w2 - l0 - l1 - l2 AS BIGINT) AS n_right FROM b"
    ),
    "tree_stopped_early": f"WITH {_STOPPED} SELECT p_type, prediction, count(*) AS n FROM last JOIN labels USING (node) GROUP BY ALL",
    "tree_full": (
        f"WITH {_FULL} SELECT CAST(length(node) AS INT) AS depth, prediction, count(*) AS n FROM last JOIN labels USING (node) GROUP BY ALL"
    ),
    "tree_routed_by_joins": f"WITH {_STOPPED} SELECT p_partkey, prediction FROM last JOIN labels USING (node)",
    "tree_saved_predict": f"WITH {_STOPPED} SELECT p_type, prediction, count(*) AS n FROM last JOIN labels USING (node) GROUP BY ALL",
}
