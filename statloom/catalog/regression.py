"""Linear regression, one-hot encoding and sums of products."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import load, rounded
from statloom.functions.metrics import r2
from statloom.operators.encode import category_levels, one_hot, one_hot_name, one_hot_sparse
from statloom.operators.matrix import cross_products
from statloom.plans.linear_regression import LinearModel, LinearRegression, fit_linear
from statloom.session import shared_folder, small_frame

THREE = ["l_quantity", "l_discount", "l_tax"]
PART_X = ["p_partkey", "p_size"]


def _coefficients(spark: SparkSession, model: LinearModel, digits: int) -> DataFrame:
    return rounded(small_frame(spark, model.coefficient_rows(), "position int, name string, value double"), value=digits)


def simple(spark: SparkSession, d: str) -> DataFrame:
    """One regressor: price by quantity."""
    return _coefficients(spark, fit_linear(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), 4)


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Two regressors on part."""
    return _coefficients(spark, fit_linear(load(spark, d, "part"), PART_X, "p_retailprice"), 6)


def coefficients_three(spark: SparkSession, d: str) -> DataFrame:
    """Three regressors on lineitem."""
    return _coefficients(spark, fit_linear(load(spark, d, "lineitem"), THREE, "l_extendedprice"), 4)


def large_keys(spark: SparkSession, d: str) -> DataFrame:
    """A regressor of some 10**8 with a small spread: price by a long order key."""
    lines = load(spark, d, "lineitem").withColumn("x", F.col("l_orderkey") * 1000 + 600_000_000)
    return _coefficients(spark, fit_linear(lines, ["x"], "l_extendedprice"), 7)


def epoch_seconds(spark: SparkSession, d: str) -> DataFrame:
    """A regressor of some 10**9: price by the second of the ship date."""
    lines = load(spark, d, "lineitem").withColumn("x", F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    return _coefficients(spark, fit_linear(lines, ["x"], "l_extendedprice"), 7)


def predict(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    scored = fit_linear(part, PART_X, "p_retailprice").transform(part)
    return rounded(scored.select("p_partkey", "y_prediction"), y_prediction=6)


def score(spark: SparkSession, d: str) -> DataFrame:
    """R² over every lineitem."""
    lineitem = load(spark, d, "lineitem")
    scored = fit_linear(lineitem, THREE, "l_extendedprice").transform(lineitem)
    return rounded(r2(scored, "l_extendedprice", "y_prediction"), r2=9)


def one_hot_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """All levels of a category plus an intercept: the minimum-norm answer."""
    model = fit_linear(load(spark, d, "part"), ["p_type", "p_size"], "p_retailprice", encode=True)
    return _coefficients(spark, model, 6)


def one_hot_predict(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    scored = fit_linear(part, ["p_type", "p_size"], "p_retailprice", encode=True).transform(part)
    return rounded(scored.select("p_partkey", "y_prediction"), y_prediction=6)


def one_hot_encode(spark: SparkSession, d: str) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return one_hot(customer, category_levels(customer, ["c_mktsegment"])).drop("c_mktsegment")


def _orders_by_name(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return load(spark, d, "orders").join(names, "o_custkey").select("o_orderkey", "c_name", F.month("o_orderdate").alias("month"), "o_totalprice")


def many_levels(spark: SparkSession, d: str) -> DataFrame:
    """Prices by customer name, a level each, and month: levels are a table, not columns."""
    model = fit_linear(_orders_by_name(spark, d), ["c_name", "month"], "o_totalprice", encode=True, inline_levels=100)
    return rounded(model.coefficient_table(spark).select("name", "value"), value=4)


def many_levels_predict(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders_by_name(spark, d)
    scored = fit_linear(orders, ["c_name", "month"], "o_totalprice", encode=True, inline_levels=100).transform(orders)
    return rounded(scored.select("o_orderkey", "y_prediction"), y_prediction=6)


def one_hot_many(spark: SparkSession, d: str) -> DataFrame:
    """The place of each customer's 1 among as many columns as there are names."""
    return one_hot_sparse(load(spark, d, "customer").select("c_custkey", "c_name"), "c_name").drop("c_name")


def saved_predicts(spark: SparkSession, d: str) -> DataFrame:
    """A model saved, loaded under its name and used again; with its quality, as saved."""
    part = load(spark, d, "part")
    base = f"{shared_folder(spark)}/models-{uuid.uuid4()}"
    LinearRegression(spark, base).create_model(part, PART_X, "p_retailprice", "prices").estimate().predict().score()
    again = LinearRegression(spark, base).load_model("prices")
    return rounded(again.predict(part).predictions.select("p_partkey", "y_prediction", F.lit(again.get_score()).alias("r2")), y_prediction=6, r2=9)


def saved_models(spark: SparkSession, d: str) -> DataFrame:
    """Ids, names and states of saved models, one of which was dropped."""
    part = load(spark, d, "part")
    base = f"{shared_folder(spark)}/models-{uuid.uuid4()}"
    for name in ("first", "second", "third"):
        LinearRegression(spark, base).create_model(part, ["p_size"], "p_retailprice", name).estimate()
    LinearRegression(spark, base).load_model("first").predict(part).score()
    LinearRegression(spark, base).drop_model("second")
    return LinearRegression(spark, base).get_model_list().select("name", "state")


def products(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of every pair of lineitem's measures."""
    names = ["l_quantity", "l_discount", "l_tax"]
    return rounded(cross_products(load(spark, d, "lineitem"), names), v=4)


def _covariances(table: str, x: list[str], y: str) -> str:
    parts = [f"avg({c}) AS a{i}" for i, c in enumerate(x, 1)] + [f"avg({y}) AS ay"]
    for i, a in enumerate(x, 1):
        parts += [f"covar_pop({a}, {b}) AS s{i}{j}" for j, b in enumerate(x, 1)]
        parts.append(f"covar_pop({a}, {y}) AS s{i}y")
    return f"m AS (SELECT {', '.join(parts)} FROM {table})"


_TWO = (
    "b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
    "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)"
)


def _det3(columns: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = columns
    return f"({a}*({e}*{i}-{f}*{h}) - {d}*({b}*{i}-{c}*{h}) + {g}*({b}*{f}-{c}*{e}))"


def _three() -> str:
    cols = [[f"s{r}{c}" for r in (1, 2, 3)] for c in (1, 2, 3)]
    y = ["s1y", "s2y", "s3y"]
    solved = [
        f"{_det3([y if k == c else cols[k] for k in range(3)])} / {_det3(cols)} AS b{c + 1}" for c in range(3)
    ]
    return f"b AS (SELECT *, {', '.join(solved)} FROM m)"


def _rows(names: list[str], values: list[str], digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{n}' AS name, round({v}, {digits}) AS value FROM b"
        for i, (n, v) in enumerate(zip(names, values))
    )


_GROUPS = (
    "g AS (SELECT p_type, avg(p_size) AS gx, avg(p_retailprice) AS gy, "
    "count(*) * var_pop(p_size) AS sxx, count(*) * covar_pop(p_size, p_retailprice) AS sxy FROM part GROUP BY p_type), "
    "s AS (SELECT sum(sxy) / sum(sxx) AS slope FROM g), "
    "a AS (SELECT p_type, gy - slope * gx AS level, slope FROM g, s), "
    "t AS (SELECT sum(level) / (count(*) + 1) AS t0, any_value(slope) AS slope FROM a)"
)

_NAMES = (
    "o AS (SELECT o_orderkey, c_name, month(o_orderdate) AS month, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey), "
    "g AS (SELECT c_name, avg(month) AS gx, avg(o_totalprice) AS gy, count(*) * var_pop(month) AS sxx, "
    "count(*) * covar_pop(month, o_totalprice) AS sxy FROM o GROUP BY c_name), "
    "s AS (SELECT sum(sxy) / sum(sxx) AS slope FROM g), a AS (SELECT c_name, gy - slope * gx AS level, slope FROM g, s), "
    "t AS (SELECT sum(level) / (count(*) + 1) AS t0, any_value(slope) AS slope FROM a)"
)

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

def _one_regressor(x: str, digits: int) -> str:
    """Centred before it is summed, so that large values cost no digits."""
    return (
        f"WITH v AS (SELECT {x} AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT avg(x) AS ax, avg(y) AS ay FROM v), "
        "b AS (SELECT sum((x - ax) * (y - ay)) / sum((x - ax) * (x - ax)) AS b, any_value(ax) AS ax, any_value(ay) AS ay FROM v, a) "
        f"SELECT CAST(0 AS INT) AS position, 'intercept' AS name, round(ay - b * ax, {digits}) AS value FROM b UNION ALL "
        f"SELECT CAST(1 AS INT), 'x', round(b, {digits}) FROM b"
    )


QUERIES = {
    "linreg_simple": simple,
    "linreg_coefficients": coefficients,
    "linreg_coefficients_three": coefficients_three,
    "linreg_large_keys": large_keys,
    "linreg_epoch_seconds": epoch_seconds,
    "linreg_predict": predict,
    "linreg_r2": score,
    "linreg_one_hot_coefficients": one_hot_coefficients,
    "linreg_one_hot_predict": one_hot_predict,
    "linreg_many_levels": many_levels,
    "linreg_many_levels_predict": many_levels_predict,
    "linreg_saved_predict": saved_predicts,
    "linreg_saved_models": saved_models,
    "one_hot_encode": one_hot_encode,
    "one_hot_sparse": one_hot_many,
    "sums_of_products": products,
}

ORACLES = {
    "linreg_simple": (
        "SELECT CAST(0 AS INT) AS position, 'intercept' AS name, "
        "round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL "
        "SELECT CAST(1 AS INT), 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"
    ),
    "linreg_coefficients": (
        f"WITH {_covariances('part', PART_X, 'p_retailprice')}, {_TWO} "
        + _rows(["intercept", *PART_X], ["ay - b1 * a1 - b2 * a2", "b1", "b2"], 6)
    ),
    "linreg_coefficients_three": (
        f"WITH {_covariances('lineitem', THREE, 'l_extendedprice')}, {_three()} "
        + _rows(["intercept", *THREE], ["ay - b1 * a1 - b2 * a2 - b3 * a3", "b1", "b2", "b3"], 4)
    ),
    "linreg_large_keys": _one_regressor("CAST(l_orderkey * 1000 + 600000000 AS DOUBLE)", 7),
    "linreg_epoch_seconds": _one_regressor("CAST(epoch(l_shipdate) AS DOUBLE)", 7),
    "linreg_predict": (
        f"WITH {_covariances('part', PART_X, 'p_retailprice')}, {_TWO} "
        "SELECT p_partkey, round(ay + b1 * (p_partkey - a1) + b2 * (p_size - a2), 6) AS y_prediction FROM part, b"
    ),
    "linreg_r2": (
        f"WITH {_covariances('lineitem', THREE, 'l_extendedprice')}, {_three()}, "
        "p AS (SELECT l_extendedprice AS y, ay + b1 * (l_quantity - a1) + b2 * (l_discount - a2) + b3 * (l_tax - a3) AS f "
        "FROM lineitem, b) "
        "SELECT round(1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)), 9) AS r2 FROM p"
    ),
    "linreg_one_hot_coefficients": (
        f"WITH {_GROUPS} SELECT CAST(0 AS INT) AS position, 'intercept' AS name, round(t0, 6) AS value FROM t UNION ALL "
        "SELECT CAST(row_number() OVER (ORDER BY p_type) AS INT), 'linreg_ohe_p_type_' || p_type, round(level - t0, 6) FROM a, t "
        "UNION ALL SELECT CAST((SELECT count(*) + 1 FROM a) AS INT), 'p_size', round(slope, 6) FROM t"
    ),
    "linreg_one_hot_predict": (
        f"WITH {_GROUPS} SELECT p_partkey, round(level + slope * p_size, 6) AS y_prediction FROM part JOIN a USING (p_type)"
    ),
    "linreg_many_levels": (
        f"WITH {_NAMES} SELECT 'intercept' AS name, round(t0, 4) AS value FROM t UNION ALL "
        "SELECT 'linreg_ohe_c_name_' || c_name, round(level - t0, 4) FROM a, t UNION ALL SELECT 'month', round(slope, 4) FROM t"
    ),
    "linreg_many_levels_predict": f"WITH {_NAMES} SELECT o_orderkey, round(level + slope * month, 6) AS y_prediction FROM o JOIN a USING (c_name)",
    "linreg_saved_predict": (
        f"WITH {_covariances('part', PART_X, 'p_retailprice')}, {_TWO}, "
        "p AS (SELECT p_partkey, p_retailprice AS y, ay + b1 * (p_partkey - a1) + b2 * (p_size - a2) AS f FROM part, b), "
        "q AS (SELECT 1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)) AS r2 FROM p) "
        "SELECT p_partkey, round(f, 6) AS y_prediction, round(r2, 9) AS r2 FROM p, q"
    ),
    "linreg_saved_models": "SELECT * FROM (VALUES ('first', CAST(3 AS INT)), ('third', 1)) AS v(name, state) WHERE (SELECT count(*) FROM part) > 0",
    "one_hot_sparse": (
        "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS index, (SELECT count(DISTINCT c_name) FROM customer) AS size FROM customer"
    ),
    "one_hot_encode": "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INT) AS {one_hot_name('c_mktsegment', s)}" for s in _SEGMENTS
    )
    + " FROM customer",
    "sums_of_products": " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INT) AS i, CAST({j + 1} AS INT) AS j, round(sum({a} * {b}), 4) AS v FROM lineitem"
        for i, a in enumerate(THREE)
        for j, b in enumerate(THREE)
    ),
}
