"""Gaussian class densities and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import load, rounded
from statloom.functions.metrics import accuracy
from statloom.plans.gaussian import GaussianModel, fit_gaussian
from statloom.plans.gaussian_table import fit_gaussian_table

THREE = ["l_quantity", "l_extendedprice", "l_discount"]
TWO = ["p_size", "p_retailprice"]


def _lineitem(spark: SparkSession, d: str, multivariate: bool, x: list[str]) -> tuple[DataFrame, GaussianModel]:
    lineitem = load(spark, d, "lineitem")
    return lineitem, fit_gaussian(lineitem, x, "l_returnflag", multivariate)


def _part(spark: SparkSession, d: str, multivariate: bool) -> tuple[DataFrame, GaussianModel]:
    part = load(spark, d, "part")
    return part, fit_gaussian(part, TWO, "p_type", multivariate)


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Means, population variances and priors per class and feature."""
    _, model = _lineitem(spark, d, False, THREE)
    return rounded(model.parameters(spark), prior=10, mean=6, variance=2)


def priors(spark: SparkSession, d: str) -> DataFrame:
    _, model = _part(spark, d, False)
    return rounded(model.priors(spark), prior=10)


def univariate_predict(spark: SparkSession, d: str) -> DataFrame:
    part, model = _part(spark, d, False)
    return rounded(model.transform(part).select("p_partkey", "y_prediction", "probability"), probability=12)


def univariate_probabilities(spark: SparkSession, d: str) -> DataFrame:
    part, model = _part(spark, d, False)
    return rounded(model.class_probabilities(part).select("p_partkey", "y_class", "probability"), probability=12)


def univariate_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Every lineitem: rows per class and prediction."""
    lineitem, model = _lineitem(spark, d, False, THREE)
    return model.transform(lineitem).groupBy("l_returnflag", "y_prediction").agg(F.count("*").alias("n"))


def univariate_accuracy(spark: SparkSession, d: str) -> DataFrame:
    lineitem, model = _lineitem(spark, d, False, THREE)
    return rounded(accuracy(model.transform(lineitem), "l_returnflag", "y_prediction"), accuracy=10)


def covariances(spark: SparkSession, d: str) -> DataFrame:
    """Population covariances of three features per class."""
    _, model = _lineitem(spark, d, True, THREE)
    return rounded(model.covariances(spark).drop("inverse"), covariance=2)


def inverses(spark: SparkSession, d: str) -> DataFrame:
    _, model = _part(spark, d, True)
    return rounded(model.covariances(spark), covariance=6, inverse=12)


def determinants(spark: SparkSession, d: str) -> DataFrame:
    _, model = _part(spark, d, True)
    return rounded(model.determinants(spark).drop("ridge"), determinant=2)


def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    part, model = _part(spark, d, True)
    return rounded(model.mahalanobis(part).select("p_partkey", "y_class", "distance"), distance=8)


def multivariate_predict(spark: SparkSession, d: str) -> DataFrame:
    part, model = _part(spark, d, True)
    return rounded(model.transform(part).select("p_partkey", "y_prediction", "probability"), probability=12)


def multivariate_confusion(spark: SparkSession, d: str) -> DataFrame:
    lineitem, model = _lineitem(spark, d, True, ["l_quantity", "l_extendedprice"])
    return model.transform(lineitem).groupBy("l_returnflag", "y_prediction").agg(F.count("*").alias("n"))


def encoded_feature(spark: SparkSession, d: str) -> DataFrame:
    """A string feature, which travels as its ordinal."""
    orders = load(spark, d, "orders")
    model = fit_gaussian(orders, ["o_totalprice", "o_orderpriority"], "o_orderstatus", multivariate=False)
    return model.transform(orders).groupBy("o_orderstatus", "y_prediction").agg(F.count("*").alias("n"))


def embedding_confusion(spark: SparkSession, d: str) -> DataFrame:
    """64 features and ten classes, scored as matrix products per batch."""
    vectors = load(spark, d, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    model = fit_gaussian(wide, names, "label", multivariate=False)
    return model.transform(wide).groupBy("label", "y_prediction").agg(F.count("*").alias("n"))


def embedding_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of every vector to every label's mean over 64 features, by whole batches."""
    vectors = load(spark, d, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    model = fit_gaussian(wide, names, "label", multivariate=False)
    return rounded(model.mahalanobis(wide).select("vec_id", "y_class", "distance"), distance=6)


def many_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every order by the likeliest of all customers, whose parameters are a table."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    found = fit_gaussian_table(orders, ["o_totalprice", "day"], "o_custkey", multivariate=False).transform(orders)
    return rounded(found.select("o_orderkey", "y_prediction", F.ln("probability").alias("log_probability")), log_probability=6)


def _univariate(table: str, key: str, x: list[str], y: str) -> str:
    """Log of prior * density per row and class."""
    stats = ", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(x))
    density = " ".join(f"- 0.5 * ln(2 * pi() * v{i}) - ({c} - m{i}) * ({c} - m{i}) / (2 * v{i})" for i, c in enumerate(x))
    return (
        f"c AS (SELECT {y} AS y_class, count(*) / (SELECT count(*) FROM {table}) AS prior, {stats} FROM {table} GROUP BY {y}), "
        f"s AS (SELECT {key}, t.{y} AS y_true, y_class, ln(prior) {density} AS score FROM {table} t, c)"
    )


def _multivariate(table: str, key: str, x: tuple[str, str], y: str) -> str:
    a, b = x
    return (
        f"c AS (SELECT {y} AS y_class, count(*) / (SELECT count(*) FROM {table}) AS prior, avg({a}) AS ma, avg({b}) AS mb, "
        f"var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab FROM {table} GROUP BY {y}), "
        "e AS (SELECT *, saa * sbb - sab * sab AS det FROM c), "
        f"q AS (SELECT {key}, t.{y} AS y_true, y_class, prior, det, "
        f"(sbb * ({a} - ma) * ({a} - ma) - 2 * sab * ({a} - ma) * ({b} - mb) + saa * ({b} - mb) * ({b} - mb)) / det AS distance "
        f"FROM {table} t, e), "
        "s AS (SELECT *, ln(prior) - ln(2 * pi()) - 0.5 * ln(det) - 0.5 * distance AS score FROM q)"
    )


def _best(key: str) -> str:
    return f"w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, y_class) = 1)"


_PART_UNI = _univariate("part", "p_partkey", TWO, "p_type")
_PART_MULTI = _multivariate("part", "p_partkey", ("p_size", "p_retailprice"), "p_type")
_NUMBERED = "l AS (SELECT row_number() OVER () AS i, * FROM lineitem)"
_LINE_UNI = f"{_NUMBERED}, {_univariate('l', 'i', THREE, 'l_returnflag')}, {_best('i')}"
_LINE_MULTI = f"{_NUMBERED}, {_multivariate('l', 'i', ('l_quantity', 'l_extendedprice'), 'l_returnflag')}, {_best('i')}"
_PREDICTED = "SELECT p_partkey, y_class AS y_prediction, round(exp(score), 12) AS probability FROM w"

QUERIES = {
    "gaussian_many_classes": many_classes,
    "gaussian_parameters": parameters,
    "gaussian_priors": priors,
    "gaussian_univariate_predict": univariate_predict,
    "gaussian_univariate_probabilities": univariate_probabilities,
    "gaussian_univariate_confusion": univariate_confusion,
    "gaussian_univariate_accuracy": univariate_accuracy,
    "gaussian_covariances": covariances,
    "gaussian_inverses": inverses,
    "gaussian_determinants": determinants,
    "gaussian_mahalanobis": mahalanobis,
    "gaussian_multivariate_predict": multivariate_predict,
    "gaussian_multivariate_confusion": multivariate_confusion,
    "gaussian_encoded_feature": encoded_feature,
    "gaussian_embedding_confusion": embedding_confusion,
    "gaussian_embedding_distances": embedding_distances,
}

ORACLES = {
    "gaussian_many_classes": (
        "WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice AS a, dayofyear(o_orderdate) AS b FROM orders), "
        "c AS (SELECT o_custkey AS y, count(*) / (SELECT count(*) FROM f) AS p, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb FROM f GROUP BY 1), "
        "g AS (SELECT y, p, ma, mb, greatest(va, 1e-9 * max(va) OVER ()) AS va, greatest(vb, 1e-9 * max(vb) OVER ()) AS vb FROM c), "
        "s AS (SELECT o_orderkey, y, ln(p) - 0.5 * (ln(2 * pi() * va) + ln(2 * pi() * vb)) - (a - ma) * (a - ma) / (2 * va) - (b - mb) * (b - mb) / (2 * vb) AS score "
        "FROM f, g QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, y) = 1) "
        "SELECT o_orderkey, y AS y_prediction, round(ln(exp(score)), 6) AS log_probability FROM s"
    ),
    "gaussian_parameters": " UNION ALL ".join(
        f"SELECT l_returnflag AS y, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 10) AS prior, "
        f"'{c}' AS feature, round(avg({c}), 6) AS mean, round(var_pop({c}), 2) AS variance FROM lineitem GROUP BY l_returnflag"
        for c in THREE
    ),
    "gaussian_priors": (
        "SELECT p_type AS y, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 10) AS prior FROM part GROUP BY p_type"
    ),
    "gaussian_univariate_predict": f"WITH {_PART_UNI}, {_best('p_partkey')} {_PREDICTED}",
    "gaussian_univariate_probabilities": (
        f"WITH {_PART_UNI} SELECT p_partkey, y_class, round(exp(score), 12) AS probability FROM s"
    ),
    "gaussian_univariate_confusion": (
        f"WITH {_LINE_UNI} SELECT y_true AS l_returnflag, y_class AS y_prediction, count(*) AS n FROM w GROUP BY 1, 2"
    ),
    "gaussian_univariate_accuracy": (
        f"WITH {_LINE_UNI} SELECT count(*) AS cases, CAST(sum(CAST(y_true = y_class AS INT)) AS BIGINT) AS tp, "
        "round(avg(CAST(y_true = y_class AS INT)), 10) AS accuracy FROM w"
    ),
    "gaussian_covariances": " UNION ALL ".join(
        f"SELECT l_returnflag AS y, CAST({i + 1} AS INT) AS i, CAST({j + 1} AS INT) AS j, "
        f"round(covar_pop({a}, {b}), 2) AS covariance FROM lineitem GROUP BY l_returnflag"
        for i, a in enumerate(THREE)
        for j, b in enumerate(THREE)
    ),
    "gaussian_inverses": (
        "WITH c AS (SELECT p_type AS y, var_pop(p_size) AS a, var_pop(p_retailprice) AS b, covar_pop(p_size, p_retailprice) AS ab "
        "FROM part GROUP BY p_type), e AS (SELECT *, a * b - ab * ab AS det FROM c) "
        "SELECT y, CAST(1 AS INT) AS i, CAST(1 AS INT) AS j, round(a, 6) AS covariance, round(b / det, 12) AS inverse FROM e UNION ALL "
        "SELECT y, 1, 2, round(ab, 6), round(-ab / det, 12) FROM e UNION ALL "
        "SELECT y, 2, 1, round(ab, 6), round(-ab / det, 12) FROM e UNION ALL "
        "SELECT y, 2, 2, round(b, 6), round(a / det, 12) FROM e"
    ),
    "gaussian_determinants": (
        "SELECT p_type AS y, round(var_pop(p_size) * var_pop(p_retailprice) - covar_pop(p_size, p_retailprice) ** 2, 2) "
        "AS determinant FROM part GROUP BY p_type"
    ),
    "gaussian_mahalanobis": f"WITH {_PART_MULTI} SELECT p_partkey, y_class, round(distance, 8) AS distance FROM q",
    "gaussian_multivariate_predict": f"WITH {_PART_MULTI}, {_best('p_partkey')} {_PREDICTED}",
    "gaussian_multivariate_confusion": (
        f"WITH {_LINE_MULTI} SELECT y_true AS l_returnflag, y_class AS y_prediction, count(*) AS n FROM w GROUP BY 1, 2"
    ),
    "gaussian_encoded_feature": (
        "WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, dense_rank() OVER (ORDER BY o_orderpriority) AS code FROM orders), "
        f"{_univariate('o', 'o_orderkey', ['o_totalprice', 'code'], 'o_orderstatus')}, {_best('o_orderkey')} "
        "SELECT y_true AS o_orderstatus, y_class AS y_prediction, count(*) AS n FROM w GROUP BY 1, 2"
    ),
    "gaussian_embedding_confusion": (
        "WITH v AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), "
        "c AS (SELECT label AS y_class, k, avg(v) AS m, var_pop(v) AS s FROM v GROUP BY label, k), "
        "p AS (SELECT label AS y_class, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM embeddings GROUP BY label), "
        "d AS (SELECT vec_id, v.label AS y_true, y_class, sum(-0.5 * ln(2 * pi() * s) - (v - m) ** 2 / (2 * s)) AS density "
        "FROM v JOIN c USING (k) GROUP BY ALL), "
        "s AS (SELECT vec_id, y_true, y_class, density + prior AS score FROM d JOIN p USING (y_class)), "
        f"{_best('vec_id')} SELECT y_true AS label, y_class AS y_prediction, count(*) AS n FROM w GROUP BY 1, 2"
    ),
    "gaussian_embedding_distances": (
        "WITH v AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), "
        "c AS (SELECT label AS y_class, k, avg(v) AS m, var_pop(v) AS s FROM v GROUP BY label, k) "
        "SELECT vec_id, y_class, round(sum((v - m) ** 2 / s), 6) AS distance FROM v JOIN c USING (k) GROUP BY ALL"
    ),
}
