"""Matrix products and transposes over the embeddings and the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import load, rounded
from statloom.operators.matrix import (
    cross_products,
    from_blocks,
    multiply_coordinates,
    multiply_matrices,
    salted,
    to_blocks,
    to_coordinates,
    to_wide,
    transpose,
    transpose_blocks,
    transpose_coordinates,
)

DIMENSIONS = 64
LABELS = 10
COMPONENTS = [f"e{i}" for i in range(1, DIMENSIONS + 1)]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    cells = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)]
    return vectors.select(F.col("vec_id").alias("id"), "label", *cells)


def _label_means(spark: SparkSession, d: str) -> DataFrame:
    """One row per label (id), one column per component; read more than once below."""
    cells = load(spark, d, "embeddings").select(F.col("label").alias("i"), F.posexplode("embedding").alias("k", "v"))
    means = cells.groupBy("i", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return to_wide(means, list(range(DIMENSIONS)), "id", "e").persist()


def product(spark: SparkSession, d: str) -> DataFrame:
    """Every vector by the transposed label means: its similarity to each label."""
    similarity = multiply_matrices(_wide(spark, d).drop("label"), transpose(_label_means(spark, d)))
    names = [c for c in similarity.columns if c != "id"]
    return rounded(similarity, **{c: 8 for c in names})


def product_small(spark: SparkSession, d: str) -> DataFrame:
    """lineitem's measures by a matrix of their own averages, as column arithmetic."""
    lineitem = load(spark, d, "lineitem")
    measures = ["l_quantity", "l_discount", "l_tax"]
    averages = lineitem.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in measures])
    ranked = averages.orderBy("l_returnflag").withColumn("id", F.ascii("l_returnflag")).drop("l_returnflag")
    wide = multiply_matrices(lineitem.select(F.col("l_orderkey").alias("id"), *measures), transpose(ranked))
    sums = wide.groupBy("id").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in (1, 2, 3)])
    return rounded(sums, x1=4, x2=4, x3=4)


def transposed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(transpose(_label_means(spark, d)), **{f"x{i + 1}": 8 for i in range(LABELS)})


def squares(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of all pairs of components."""
    return rounded(cross_products(_wide(spark, d), COMPONENTS), v=6)


def sparse_product(spark: SparkSession, d: str) -> DataFrame:
    """Quantity per part and nation: (part, supplier) cells by (supplier, nation) cells."""
    lines = load(spark, d, "lineitem")
    a = lines.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    b = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("j"), F.lit(1.0).alias("v"))
    return multiply_coordinates(a, b)


def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Label means as transposed coordinate cells."""
    return rounded(transpose_coordinates(to_coordinates(_label_means(spark, d))), v=8)


def transposed_tall(spark: SparkSession, d: str) -> DataFrame:
    """All orders by three measures, transposed in blocks: three rows of as many columns as there are orders."""
    orders = load(spark, d, "orders")
    wide = orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_custkey", F.month("o_orderdate").alias("month"))
    return from_blocks(transpose_blocks(to_blocks(wide)))


def _with_hot_part(key: str) -> F.Column:
    """A key that is 0 for half of the rows."""
    return F.when(F.col(key) % 2 == 0, F.col(key)).otherwise(F.lit(0).cast("long"))


def sparse_product_hot(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by order and part group, times sizes by part group; one group holds half of all cells."""
    left = load(spark, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("i"), _with_hot_part("l_partkey").alias("k"), F.col("l_quantity").alias("v"))
    right = load(spark, d, "part").select(_with_hot_part("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("j"), F.col("p_size").cast("double").alias("v"))
    # The salted way, whatever the size of the right side.
    a, b = left.groupBy("i", "k").agg(F.sum("v").alias("va")), right.groupBy("k", "j").agg(F.sum("v").alias("vb"))
    return salted(a, b, 500).groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


_CELLS = (
    "v AS (SELECT vec_id, label, CAST(unnest(range(64)) + 1 AS INT) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), "
    "m AS (SELECT label, k, avg(v) AS m FROM v GROUP BY label, k)"
)

QUERIES = {
    "matrix_product": product,
    "matrix_product_small": product_small,
    "matrix_transpose": transposed,
    "matrix_transpose_tall": transposed_tall,
    "matrix_cross_products": squares,
    "sparse_product": sparse_product,
    "sparse_product_hot_key": sparse_product_hot,
    "matrix_coordinates": coordinates,
}

ORACLES = {
    "matrix_product": (
        f"WITH {_CELLS}, p AS (SELECT vec_id AS id, m.label, sum(v.v * m.m) AS s FROM v JOIN m USING (k) GROUP BY 1, 2) SELECT id, "
        + ", ".join(f"round(max(CASE WHEN label = {i} THEN s END), 8) AS x{i + 1}" for i in range(LABELS))
        + " FROM p GROUP BY id"
    ),
    "matrix_product_small": (
        "WITH a AS (SELECT l_returnflag AS y, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1) "
        "SELECT l_orderkey AS id, "
        + ", ".join(
            f"round(sum(CASE WHEN y = '{y}' THEN l_quantity * q + l_discount * d + l_tax * t END), 4) AS x{i}"
            for i, y in enumerate(("A", "N", "R"), 1)
        )
        + " FROM lineitem, a GROUP BY l_orderkey"
    ),
    "matrix_transpose": f"WITH {_CELLS} SELECT k AS id, "
    + ", ".join(f"round(max(CASE WHEN label = {i} THEN m END), 8) AS x{i + 1}" for i in range(LABELS))
    + " FROM m GROUP BY k",
    "matrix_cross_products": (
        f"WITH {_CELLS} SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v), 6) AS v FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2"
    ),
    "sparse_product": (
        "SELECT l_partkey AS i, s_nationkey AS j, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
    ),
    "matrix_transpose_tall": (
        "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_totalprice, o_custkey, month(o_orderdate) AS m FROM orders) "
        "SELECT CAST(1 AS BIGINT) AS i, k, CAST(o_totalprice AS DOUBLE) AS v FROM o UNION ALL SELECT 2, k, CAST(o_custkey AS DOUBLE) FROM o "
        "UNION ALL SELECT 3, k, CAST(m AS DOUBLE) FROM o"
    ),
    "sparse_product_hot_key": (
        "WITH a AS (SELECT l_orderkey % 2000 AS i, CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE 0 END AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), "
        "b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END AS k, p_partkey % 7 AS j, sum(p_size) AS v FROM part GROUP BY ALL) "
        "SELECT i, j, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b USING (k) GROUP BY ALL"
    ),
    "matrix_coordinates": f"WITH {_CELLS} SELECT k AS i, label AS k, round(m, 8) AS v FROM m",
}
