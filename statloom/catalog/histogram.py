"""Quantisation, histogram models and feature ranking.

Models are fitted on the training part of orders and applied to the rest, so
values between, below and above the fitted buckets and unseen cells occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import draw_sql, load, rounded
from statloom.functions.metrics import accuracy
from statloom.operators.quantile import equal_frequency_buckets, equal_width, quantise
from statloom.operators.split import bernoulli_split
from statloom.plans.histogram import HistogramModel, fit_histogram, rank_features

NUMERIC = ["o_totalprice", "o_custkey"]
BINS = 30
RANKED = {"lineitem": (["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"], 20)}


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bernoulli_split(load(spark, d, "orders"), 0.8, 1, "o_orderkey", "md5")


def _fitted(spark: SparkSession, d: str) -> tuple[HistogramModel, DataFrame]:
    train, rest = _parts(spark, d)
    return fit_histogram(train, "o_orderstatus", ["o_orderpriority"], NUMERIC, BINS), rest


def equal_frequency(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    buckets = equal_frequency_buckets(orders, NUMERIC, BINS)
    return quantise(orders, buckets, {c: f"q_{c}" for c in NUMERIC}).select("o_orderkey", *[f"q_{c}" for c in NUMERIC])


def equal_widths(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    return equal_width(orders, NUMERIC, BINS, {c: f"w_{c}" for c in NUMERIC}).select("o_orderkey", *[f"w_{c}" for c in NUMERIC])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d)[0].edges()


def contingency(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d)[0].contingency()


def predict(spark: SparkSession, d: str) -> DataFrame:
    model, rest = _fitted(spark, d)
    return rounded(model.predict(rest).select("o_orderkey", "prediction", "measure", "matched"), measure=12)


def density(spark: SparkSession, d: str) -> DataFrame:
    """Joint probability of each class seen in a row's cell."""
    model, rest = _fitted(spark, d)
    return rounded(model.density(rest).select("o_orderkey", "y_", "measure"), measure=12)


def score(spark: SparkSession, d: str) -> DataFrame:
    model, rest = _fitted(spark, d)
    return rounded(accuracy(model.predict(rest), "o_orderstatus", "prediction"), accuracy=10)


def density_numeric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fitted(spark, d)[0].density_1d("o_totalprice"), x_=4, p=10, p_given_y=10)


def density_categorical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fitted(spark, d)[0].density_1d("o_orderpriority"), p=10, p_given_y=10)


def density_two(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_fitted(spark, d)[0].density_2d("o_totalprice", "o_orderpriority"), x_=4, p=10, p_given_y=10)


def predict_by_width(spark: SparkSession, d: str) -> DataFrame:
    """The same prediction with buckets of equal width."""
    train, rest = _parts(spark, d)
    model = fit_histogram(train, "o_orderstatus", ["o_orderpriority"], NUMERIC, BINS, edges="width")
    return rounded(model.predict(rest).select("o_orderkey", "prediction", "measure", "matched"), measure=12)


def density_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Joint probability of each class in a row's cell of two of the three features."""
    model, rest = _fitted(spark, d)
    return rounded(model.density(rest, ["o_totalprice", "o_orderpriority"]).select("o_orderkey", "y_", "measure"), measure=12)


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """Features of lineitem by information about the return flag."""
    numeric, categorical, bins = RANKED["lineitem"]
    return rounded(rank_features(load(spark, d, "lineitem"), categorical, numeric, bins, "l_returnflag"), mi=10)


def ranking_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same with buckets found in chunks of a thousand rows."""
    numeric, categorical, bins = RANKED["lineitem"]
    return rounded(rank_features(load(spark, d, "lineitem"), categorical, numeric, bins, "l_returnflag", 1_000), mi=10)


def _bucket(column: str, bins: int = BINS) -> str:
    return f"CAST(({bins} * rank() OVER (ORDER BY {column}) + count(*) OVER () - 1) // count(*) OVER () AS INT)"


_DRAW = draw_sql("o_orderkey")


def _edge(name: str, column: str) -> str:
    return (
        f"{name} AS (SELECT xq, mn, mx, n, lead(mn) OVER (ORDER BY xq) AS next_mn, row_number() OVER (ORDER BY xq) = 1 AS is_first "
        f"FROM (SELECT q_{column} AS xq, min({column}) AS mn, max({column}) AS mx, count(*) AS n FROM q GROUP BY q_{column}))"
    )


def _width(column: str) -> str:
    least, most = f"min({column}) OVER ()", f"max({column}) OVER ()"
    return f"CAST(least(greatest(floor({BINS} * (CAST({column} AS DOUBLE) - {least}) / ({most} - {least})) + 1, 1), {BINS}) AS INT)"


_FIT = (
    f"t AS (SELECT * FROM orders WHERE {_DRAW} < 0.8), r AS (SELECT * FROM orders WHERE {_DRAW} >= 0.8), "
    f"q AS (SELECT *, {_bucket('o_totalprice')} AS q_o_totalprice, {_bucket('o_custkey')} AS q_o_custkey FROM t), "
    f"{_edge('ep', 'o_totalprice')}, {_edge('ec', 'o_custkey')}, "
    "cells AS (SELECT o_orderstatus AS y, q_o_totalprice, q_o_custkey, o_orderpriority, count(*) AS nxy FROM q GROUP BY ALL), "
    "ny AS (SELECT y, CAST(sum(nxy) AS BIGINT) AS n_y FROM cells GROUP BY y), "
    "nn AS (SELECT CAST(sum(nxy) AS BIGINT) AS n_all FROM cells)"
)


def _bucket_of(edge: str, column: str) -> str:
    """The last bucket that begins at or below the value, else the first bucket."""
    begun = f"SELECT max_by(xq, mn) FROM {edge} WHERE mn <= {column}"
    return f"coalesce(({begun}), (SELECT xq FROM {edge} WHERE is_first))"


_PLACED = (
    f"{_FIT}, e AS (SELECT r.*, {_bucket_of('ep', 'r.o_totalprice')} AS q_o_totalprice, "
    f"{_bucket_of('ec', 'r.o_custkey')} AS q_o_custkey FROM r), "
    "best AS (SELECT * FROM cells QUALIFY row_number() OVER "
    "(PARTITION BY q_o_totalprice, q_o_custkey, o_orderpriority ORDER BY nxy DESC, y) = 1), "
    "major AS (SELECT y AS majority FROM ny ORDER BY n_y DESC, y LIMIT 1), "
    "p AS (SELECT o_orderkey, o_orderstatus, coalesce(y, majority) AS prediction, nxy / n_all AS measure, y IS NOT NULL AS matched "
    "FROM e LEFT JOIN best USING (q_o_totalprice, q_o_custkey, o_orderpriority), nn, major)"
)
_ENDS = "mn, coalesce(next_mn, mx) AS mx, round((mn + coalesce(next_mn, mx)) / 2, 4) AS x_, "
_LABEL = "xq || ': ]' || mn || ',' || coalesce(next_mn, mx) || ']' AS bin, "
_SHARES = "round(n / n_all, 10) AS p, round(n / n_y, 10) AS p_given_y"

_NUM, _CAT, _RANK_BINS = RANKED["lineitem"]
_PAIRS = " UNION ALL ".join(
    [f"SELECT '{c}' AS f, CAST({_bucket(c, _RANK_BINS)} AS VARCHAR) AS x, l_returnflag AS y FROM lineitem" for c in _NUM]
    + [f"SELECT '{c}', {c}, l_returnflag FROM lineitem" for c in _CAT]
)

def named_like_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose names look like those of helper columns stay."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("_value_0"), F.col("o_custkey").alias("_index_0"))
    return quantise(orders, equal_frequency_buckets(orders, ["o_totalprice"], BINS), {"o_totalprice": "q"}).drop("o_totalprice")


QUERIES = {
    "quantise_taken_names": named_like_helpers,
    "quantise_equal_frequency": equal_frequency,
    "quantise_equal_width": equal_widths,
    "histogram_edges": edges,
    "histogram_contingency": contingency,
    "histogram_predict": predict,
    "histogram_density": density,
    "histogram_accuracy": score,
    "histogram_density_1d_numeric": density_numeric,
    "histogram_density_1d_categorical": density_categorical,
    "histogram_density_2d": density_two,
    "histogram_predict_equal_width": predict_by_width,
    "histogram_density_chosen": density_chosen,
    "rank_features": ranking,
    "rank_features_chunked": ranking_in_chunks,
}

ORACLES = {
    "quantise_taken_names": f"SELECT o_orderkey, o_orderpriority AS _value_0, o_custkey AS _index_0, {_bucket('o_totalprice')} AS q FROM orders",
    "quantise_equal_frequency": f"SELECT o_orderkey, {_bucket('o_totalprice')} AS q_o_totalprice, {_bucket('o_custkey')} AS q_o_custkey FROM orders",
    "quantise_equal_width": "SELECT o_orderkey, "
    + ", ".join(
        f"CAST(least(greatest(floor({BINS} * (CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) + 1, 1), {BINS}) AS INT) "
        f"AS w_{c}"
        for c in NUMERIC
    )
    + " FROM orders",
    "histogram_edges": f"WITH {_FIT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS f, xq, CAST(mn AS DOUBLE) AS mn, CAST(mx AS DOUBLE) AS mx, CAST(next_mn AS DOUBLE) AS next_mn, "
        f"CAST(min(mn) OVER () AS DOUBLE) AS first_mn, CAST(max(mx) OVER () AS DOUBLE) AS last_mx, n FROM {e}"
        for c, e in (("o_totalprice", "ep"), ("o_custkey", "ec"))
    ),
    "histogram_contingency": (
        f"WITH {_FIT} SELECT y, q_o_totalprice, q_o_custkey, o_orderpriority, nxy, n_y, n_all, "
        "ep.mn AS o_totalprice_mn, coalesce(ep.next_mn, ep.mx) AS o_totalprice_mx, "
        "CAST(ec.mn AS DOUBLE) AS o_custkey_mn, CAST(coalesce(ec.next_mn, ec.mx) AS DOUBLE) AS o_custkey_mx "
        "FROM cells JOIN ny USING (y) JOIN ep ON q_o_totalprice = ep.xq JOIN ec ON q_o_custkey = ec.xq, nn"
    ),
    "histogram_predict": f"WITH {_PLACED} SELECT o_orderkey, prediction, round(measure, 12) AS measure, matched FROM p",
    "histogram_density": (
        f"WITH {_PLACED} SELECT o_orderkey, y AS y_, round(nxy / n_all, 12) AS measure "
        "FROM e LEFT JOIN cells USING (q_o_totalprice, q_o_custkey, o_orderpriority), nn"
    ),
    "histogram_accuracy": (
        f"WITH {_PLACED} SELECT count(*) AS cases, CAST(sum(CAST(o_orderstatus = prediction AS INT)) AS BIGINT) AS tp, "
        "round(avg(CAST(o_orderstatus = prediction AS INT)), 10) AS accuracy FROM p"
    ),
    "histogram_density_1d_numeric": (
        f"WITH {_FIT}, g AS (SELECT q_o_totalprice AS xq, y, sum(nxy) AS n FROM cells GROUP BY ALL) "
        f"SELECT xq, {_ENDS}{_LABEL}y, {_SHARES} FROM (SELECT g.xq, y, g.n, mn, mx, next_mn FROM g JOIN ep USING (xq)) JOIN ny USING (y), nn"
    ),
    "histogram_density_1d_categorical": (
        f"WITH {_FIT}, g AS (SELECT o_orderpriority AS xc, y, sum(nxy) AS n FROM cells GROUP BY ALL) "
        f"SELECT xc, y, {_SHARES} FROM g JOIN ny USING (y), nn"
    ),
    "histogram_density_2d": (
        f"WITH {_FIT}, g AS (SELECT q_o_totalprice AS xq, o_orderpriority AS xc, y, sum(nxy) AS n FROM cells GROUP BY ALL) "
        f"SELECT xq, {_ENDS}{_LABEL}xc, y, {_SHARES} FROM "
        "(SELECT g.xq, xc, y, g.n, mn, mx, next_mn FROM g JOIN ep USING (xq)) JOIN ny USING (y), nn"
    ),
    "rank_features": (
        f"WITH v AS ({_PAIRS}), c AS (SELECT f, x, y, count(*) AS n FROM v GROUP BY ALL), "
        "w AS (SELECT f, n, sum(n) OVER (PARTITION BY f, x) AS nx, sum(n) OVER (PARTITION BY f, y) AS ny, "
        "sum(n) OVER (PARTITION BY f) AS nn FROM c) "
        "SELECT f, round(sum(n / nn * log2((n / nn) / ((nx / nn) * (ny / nn)))), 10) AS mi FROM w GROUP BY f"
    ),
}
ORACLES["rank_features_chunked"] = ORACLES["rank_features"]
ORACLES["histogram_predict_equal_width"] = reduce(
    lambda sql, c: sql.replace(_bucket(c), _width(c)), ["o_totalprice", "o_custkey"], ORACLES["histogram_predict"]
)
ORACLES["histogram_density_chosen"] = (
    f"WITH {_PLACED}, two AS (SELECT y, q_o_totalprice, o_orderpriority, sum(nxy) AS nxy FROM cells GROUP BY ALL) "
    "SELECT o_orderkey, y AS y_, round(nxy / n_all, 12) AS measure FROM e LEFT JOIN two USING (q_o_totalprice, o_orderpriority), nn"
)
