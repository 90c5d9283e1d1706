"""k-means and silhouettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import load, rounded
from statloom.plans.kmeans import KMeans, KMeansModel, normalise
from statloom.session import small_frame

PART = ["p_size", "p_retailprice"]
CUSTOMER = ["c_acctbal", "c_nationkey"]
SUPPLIER = ["s_acctbal", "s_nationkey"]


def first_rows(df: DataFrame, key: str, features: list[str], k: int) -> list[list[float]]:
    """The rows with the k lowest ids, as fixed start centroids."""
    rows = df.orderBy(key).limit(k).select(*[F.col(c).cast("double") for c in features]).collect()
    return [list(r) for r in rows]


def _fitted(spark: SparkSession, d: str, table: str, key: str, features: list[str], k: int, steps: int) -> KMeansModel:
    df = load(spark, d, table)
    start = first_rows(df, key, features, k)
    model = KMeans(spark).create_model(df, features, k, table, "z-score", start=start)
    return model.estimate(steps) if steps else model


def _centroids(model: KMeansModel) -> DataFrame:
    return rounded(model.centroid_table(), value=8)


def min_max(spark: SparkSession, d: str) -> DataFrame:
    scaled = normalise(load(spark, d, "customer"), CUSTOMER, "min-max")
    return rounded(scaled.select("c_custkey", "x_0", "x_1"), x_0=10, x_1=10)


def z_score(spark: SparkSession, d: str) -> DataFrame:
    scaled = normalise(load(spark, d, "customer"), CUSTOMER, "z-score")
    return rounded(scaled.select("c_custkey", "x_0", "x_1"), x_0=10, x_1=10)


def assign(spark: SparkSession, d: str) -> DataFrame:
    model = _fitted(spark, d, "part", "p_partkey", PART, 3, 0)
    return rounded(model.transform(load(spark, d, "part")).select("p_partkey", "min_dist", "j"), min_dist=8)


def one_step(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(_fitted(spark, d, "part", "p_partkey", PART, 3, 1))


def three_steps(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(_fitted(spark, d, "part", "p_partkey", PART, 3, 3))


def information(spark: SparkSession, d: str) -> DataFrame:
    info = _fitted(spark, d, "part", "p_partkey", PART, 3, 3).get_information()
    row = [(info["n"], info["d"], info["k"], info["steps"], info["variance"])]
    return rounded(small_frame(spark, row, "n long, d int, k int, steps int, variance double"), variance=8)


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Exact average over every pair of customers."""
    value = _fitted(spark, d, "customer", "c_custkey", CUSTOMER, 3, 3).get_silhouette_avg()
    return rounded(small_frame(spark, [(value,)], "silhouette double"), silhouette=8)


def silhouette_squared(spark: SparkSession, d: str) -> DataFrame:
    value = _fitted(spark, d, "customer", "c_custkey", CUSTOMER, 3, 3).get_silhouette_avg("squared")
    return rounded(small_frame(spark, [(value,)], "silhouette double"), silhouette=8)


def ideal(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette of every k tried on supplier, and which was kept."""
    supplier = load(spark, d, "supplier")
    starts = {k: first_rows(supplier, "s_suppkey", SUPPLIER, k) for k in (2, 3)}
    factory = KMeans(spark)
    best = factory.create_ideal_model(supplier, SUPPLIER, [2, 3], "supplier", "z-score", metric="euclidean", starts=starts, max_steps=2)
    kept = best.get_information()["k"]
    rows = [(k, value, k == kept) for k, value in factory.silhouettes.items()]
    return rounded(small_frame(spark, rows, "k int, silhouette double, kept boolean"), silhouette=8)


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """Seeded start rows and steps until nothing moves, on every event."""
    events = load(spark, d, "events")
    model = KMeans(spark).create_model(events, ["value", "user_id"], 4, "events", "min-max", seed=1).estimate(20)
    return model.assignments().groupBy("j").agg(F.count("*").alias("n"))


def cluster_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 200 rows of every cluster, without copies."""
    model = _fitted(spark, d, "part", "p_partkey", PART, 3, 1)
    return rounded(model.cluster_sample(200), x_0=8, x_1=8)


def embedding_steps(spark: SparkSession, d: str) -> DataFrame:
    """64 coordinates and ten clusters, added up as matrices per batch."""
    names = [f"e{i}" for i in range(64)]
    vectors = load(spark, d, "embeddings")
    wide = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    start = first_rows(wide, "vec_id", names, 10)
    return _centroids(KMeans(spark).create_model(wide, names, 10, "embeddings", start=start).estimate(2))


def _steps(table: str, key: str, x: list[str], k: int, steps: int) -> str:
    """CTEs x, c0.., a0..: normalised rows, centroids and assignments per step."""
    scale = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(x))
    values = ", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(x))
    names = ", ".join(f"x{i}" for i in range(len(x)))
    distance = " + ".join(f"(x.x{i} - c.x{i}) * (x.x{i} - c.x{i})" for i in range(len(x)))
    ctes = [
        f"s AS (SELECT {scale} FROM {table})",
        f"x AS (SELECT {key} AS i, {values} FROM {table}, s)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS j, {names} FROM x ORDER BY i LIMIT {k})",
    ]
    for n in range(max(1, steps)):
        ctes.append(
            f"a{n} AS (SELECT x.*, c.j, {distance} AS dist FROM x, c{n} AS c "
            "QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY dist, c.j) = 1)"
        )
        means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(len(x)))
        moved = ", ".join(f"coalesce(m{i}, x{i}) AS x{i}" for i in range(len(x)))
        ctes.append(f"c{n + 1} AS (SELECT c.j, {moved} FROM c{n} AS c LEFT JOIN (SELECT j, {means} FROM a{n} GROUP BY j) USING (j))")
    return ", ".join(ctes)


def _long(centroids: str, d: int) -> str:
    return " UNION ALL ".join(
        f"SELECT j, CAST({i} AS INT) AS l, round(x{i}, 8) AS value FROM {centroids}" for i in range(d)
    )


def _silhouette(assigned: str, distance: str, tag: str = "") -> str:
    return (
        f"pair{tag} AS (SELECT p.i, p.j, q.j AS other, avg({distance}) AS dist FROM {assigned} p JOIN {assigned} q ON p.i <> q.i "
        f"GROUP BY p.i, p.j, q.j), "
        f"ab{tag} AS (SELECT i, max(CASE WHEN j = other THEN dist END) AS a, min(CASE WHEN j <> other THEN dist END) AS b "
        f"FROM pair{tag} GROUP BY i), "
        f"sil{tag} AS (SELECT round(avg((b - a) / nullif(greatest(a, b), 0)), 8) AS silhouette FROM ab{tag} WHERE a IS NOT NULL)"
    )


_EUCLIDEAN = "sqrt((p.x0 - q.x0) ** 2 + (p.x1 - q.x1) ** 2)"
_SQUARED = "(p.x0 - q.x0) ** 2 + (p.x1 - q.x1) ** 2"
_PART = ("part", "p_partkey", PART, 3)
_CUSTOMER = _steps("customer", "c_custkey", CUSTOMER, 3, 3)


QUERIES = {
    "normalise_min_max": min_max,
    "normalise_z_score": z_score,
    "kmeans_assign": assign,
    "kmeans_one_step": one_step,
    "kmeans_three_steps": three_steps,
    "kmeans_information": information,
    "kmeans_silhouette": silhouette,
    "kmeans_silhouette_squared": silhouette_squared,
    "kmeans_ideal": ideal,
    "kmeans_seeded": seeded,
    "kmeans_cluster_sample": cluster_sample,
    "kmeans_embedding_steps": embedding_steps,
}


def _scaled(shift: str, divisor: str) -> str:
    return (
        "SELECT c_custkey, "
        + ", ".join(
            f"round(({c} - {shift}({c}) OVER ()) / ({divisor.format(c=c)}), 10) AS x_{i}" for i, c in enumerate(CUSTOMER)
        )
        + " FROM customer"
    )


def _vector_step(n: int) -> str:
    """One step over (i, l, v) coordinates."""
    return (
        f"d{n} AS (SELECT i, j, sum((v.v - c.v) * (v.v - c.v)) AS dist FROM v JOIN c{n} AS c USING (l) GROUP BY i, j), "
        f"a{n} AS (SELECT i, j FROM d{n} QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) = 1), "
        f"m{n} AS (SELECT j, l, avg(v) AS v FROM v JOIN a{n} USING (i) GROUP BY j, l), "
        f"c{n + 1} AS (SELECT c.j, c.l, coalesce(m.v, c.v) AS v FROM c{n} AS c LEFT JOIN m{n} AS m USING (j, l))"
    )


def _ideal_sql() -> str:
    parts = []
    for k in (2, 3):
        inner = f"WITH {_steps('supplier', 's_suppkey', SUPPLIER, k, 2)}, {_silhouette('a1', _EUCLIDEAN)}"
        parts.append(f"SELECT CAST({k} AS INT) AS k, silhouette FROM ({inner} SELECT silhouette FROM sil)")
    return f"WITH tried AS ({' UNION ALL '.join(parts)}) SELECT k, silhouette, row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS kept FROM tried"


ORACLES = {
    "normalise_min_max": _scaled("min", "max({c}) OVER () - min({c}) OVER ()"),
    "normalise_z_score": _scaled("avg", "stddev_pop({c}) OVER ()"),
    "kmeans_assign": f"WITH {_steps(*_PART, 1)} SELECT i AS p_partkey, round(dist, 8) AS min_dist, j FROM a0",
    "kmeans_one_step": f"WITH {_steps(*_PART, 1)} {_long('c1', 2)}",
    "kmeans_three_steps": f"WITH {_steps(*_PART, 3)} {_long('c3', 2)}",
    "kmeans_information": (
        f"WITH {_steps(*_PART, 3)} SELECT count(*) AS n, CAST(2 AS INT) AS d, CAST(3 AS INT) AS k, CAST(3 AS INT) AS steps, "
        "round(sum(dist) / count(*), 8) AS variance FROM a2"
    ),
    "kmeans_silhouette": f"WITH {_CUSTOMER}, {_silhouette('a2', _EUCLIDEAN)} SELECT silhouette FROM sil",
    "kmeans_silhouette_squared": f"WITH {_CUSTOMER}, {_silhouette('a2', _SQUARED)} SELECT silhouette FROM sil",
    "kmeans_ideal": _ideal_sql(),
    "kmeans_cluster_sample": (
        f"WITH {_steps(*_PART, 1)}, h AS (SELECT p_partkey AS i, md5('1:' || CAST(CAST(p_retailprice AS DOUBLE) AS VARCHAR) || ':' || "
        "CAST(CAST(p_size AS DOUBLE) AS VARCHAR)) AS h FROM part), "
        "w AS (SELECT x0, x1, j, row_number() OVER (PARTITION BY j ORDER BY h, x0, x1) AS place FROM a0 JOIN h USING (i)) "
        "SELECT DISTINCT round(x0, 8) AS x_0, round(x1, 8) AS x_1, j FROM w WHERE place <= 200"
    ),
    "kmeans_embedding_steps": (
        "WITH v AS (SELECT vec_id AS i, CAST(unnest(range(64)) AS INT) AS l, unnest(embedding)::DOUBLE AS v FROM embeddings), "
        "f AS (SELECT vec_id AS i, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS j FROM embeddings ORDER BY vec_id LIMIT 10), "
        f"c0 AS (SELECT j, l, v FROM v JOIN f USING (i)), {_vector_step(0)}, {_vector_step(1)} "
        "SELECT j, l, round(v, 8) AS value FROM c2"
    ),
}
