"""Splits, complements, encodings, row numbers, ranks and table facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog.common import draw_sql, load
from statloom.operators.encode import category_levels, number_rows, ordinal
from statloom.operators.matrix import get_column_names, get_number_of_rows
from statloom.operators.quantile import value_ranks
from statloom.operators.split import bernoulli_split, complement, exact_split, set_complement
from statloom.sources.tables import column_types, lookup
from statloom.session import small_frame


def _halves(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.select(key, F.lit("train").alias("part")).unionByName(second.select(key, F.lit("eval").alias("part")))


def bernoulli(spark: SparkSession, d: str) -> DataFrame:
    return _halves(*bernoulli_split(load(spark, d, "orders"), 0.8, 1, "o_orderkey", "md5"), "o_orderkey")


def bernoulli_fast(spark: SparkSession, d: str) -> DataFrame:
    """The default draw, which other engines cannot repeat."""
    return _halves(*bernoulli_split(load(spark, d, "orders"), 0.8, 1, "o_orderkey"), "o_orderkey")


def exact(spark: SparkSession, d: str) -> DataFrame:
    return _halves(*exact_split(load(spark, d, "orders"), "o_orderkey", 0.8, 1, "md5"), "o_orderkey")


def _scattered(spark: SparkSession, d: str) -> DataFrame:
    """Orders by an id that is NULL for every tenth customer and repeats else."""
    customer = F.col("o_custkey") % 1000
    return load(spark, d, "orders").select(F.when(customer % 10 != 0, customer).alias("id"), "o_orderkey")


def bernoulli_scattered(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id, or with one that repeats, are in one half each."""
    return _halves(*bernoulli_split(_scattered(spark, d), 0.8, 1, "id", "md5"), "o_orderkey")


def exact_scattered(spark: SparkSession, d: str) -> DataFrame:
    """The halves have their exact sizes and hold every row once, whatever the ids."""
    both = _halves(*exact_split(_scattered(spark, d), "id", 0.8, 1, "md5"), "o_orderkey")
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"))


def complement_scattered(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id are part of the part, so none is left."""
    rows = _scattered(spark, d)
    return complement(rows, rows.where("id IS NULL OR id < 500"), "id").select("id", "o_orderkey")


def by_id(spark: SparkSession, d: str) -> DataFrame:
    """Orders outside the training part, by id."""
    orders = load(spark, d, "orders")
    train, _ = bernoulli_split(orders, 0.8, 1, "o_orderkey", "md5")
    return complement(orders, train, "o_orderkey").select("o_orderkey", "o_totalprice")


def by_set(spark: SparkSession, d: str) -> DataFrame:
    """Customer and status pairs that never occur in the training part."""
    orders = load(spark, d, "orders")
    train, _ = bernoulli_split(orders, 0.8, 1, "o_orderkey", "md5")
    return set_complement(orders.select("o_custkey", "o_orderstatus"), train.select("o_custkey", "o_orderstatus"))


def ordinal_few(spark: SparkSession, d: str) -> DataFrame:
    return ordinal(load(spark, d, "orders"), ["o_orderpriority"], {"o_orderpriority": "code"}).select("o_orderkey", "code")


def ordinal_many(spark: SparkSession, d: str) -> DataFrame:
    """A column with too many levels to inline."""
    return ordinal(load(spark, d, "customer"), ["c_name"], {"c_name": "code"}).select("c_custkey", "code")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(load(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "i")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct price with its copies and its rank among all lineitems."""
    return value_ranks(load(spark, d, "lineitem"), "l_extendedprice")


def ranked_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same in chunks of a thousand rows, whose borders come from merged sketches."""
    return value_ranks(load(spark, d, "lineitem"), "l_extendedprice", 1_000)


def numbered_taken_names(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers beside columns whose names the numbering could want for itself."""
    taken = load(spark, d, "orders").selectExpr("o_orderkey AS _seen", "o_totalprice AS _place", "o_custkey AS _part", "o_orderstatus AS _start")
    return number_rows(taken, ["_place", "_seen"], "i")


def levels(spark: SparkSession, d: str) -> DataFrame:
    found = category_levels(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    rows = [(f, n, v) for f, values in found.items() for n, v in enumerate(values, 1)]
    return small_frame(spark, rows, "f string, position int, level string")


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return small_frame(spark, [(n, get_number_of_rows(spark, load(spark, d, n))) for n in names], "name string, n long")


def columns_of(spark: SparkSession, d: str) -> DataFrame:
    """Every column of lineitem, its kind and its known values."""
    lineitem = load(spark, d, "lineitem")
    names = get_column_names(spark, lineitem)
    known = lineitem.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "name", "n")
    return column_types(lineitem).drop("type").join(F.broadcast(known), "name")


def dearest(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by the id of the dearest order."""
    orders = load(spark, d, "orders")
    top = orders.agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("id")).first()["id"]
    return lookup(orders, "o_orderkey", top).select("o_orderkey", "o_custkey", "o_totalprice")


def both_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union and plain union of two key columns."""
    ordered = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    known = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    distinct = ordered.union(known).distinct().agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    plain = ordered.unionByName(known).agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    return distinct.withColumn("kind", F.lit("distinct")).unionByName(plain.withColumn("kind", F.lit("all")))


def joined(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their label where there is one."""
    documents = load(spark, d, "documents").select("doc_id", "n_chars")
    return documents.join(load(spark, d, "labels"), "doc_id", "left").fillna(-1, ["quality", "toxic"])


_DRAW = draw_sql("o_orderkey")
_TRAIN = f"t AS (SELECT * FROM orders WHERE {_DRAW} < 0.8)"

QUERIES = {
    "split_bernoulli": bernoulli,
    "split_bernoulli_fast": bernoulli_fast,
    "split_exact": exact,
    "split_bernoulli_scattered_ids": bernoulli_scattered,
    "split_exact_scattered_ids": exact_scattered,
    "complement_scattered_ids": complement_scattered,
    "complement_by_id": by_id,
    "complement_by_set": by_set,
    "ordinal_encode": ordinal_few,
    "ordinal_encode_many": ordinal_many,
    "row_numbers": numbered,
    "number_rows_taken_names": numbered_taken_names,
    "value_ranks": ranked,
    "value_ranks_chunked": ranked_in_chunks,
    "category_levels": levels,
    "table_rows": rows_of,
    "table_columns": columns_of,
    "lookup_by_id": dearest,
    "unions": both_keys,
    "left_join": joined,
}

ORACLES = {
    "split_bernoulli": f"SELECT o_orderkey, CASE WHEN {_DRAW} < 0.8 THEN 'train' ELSE 'eval' END AS part FROM orders",
    "split_exact": (
        f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW}, o_orderkey) AS i, count(*) OVER () AS n FROM orders) "
        "SELECT o_orderkey, CASE WHEN i <= round(n * 0.8) THEN 'train' ELSE 'eval' END AS part FROM r"
    ),
    "split_bernoulli_scattered_ids": (
        f"WITH s AS (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 1000 END AS id, o_orderkey FROM orders) "
        f"SELECT o_orderkey, CASE WHEN {draw_sql("coalesce(id::VARCHAR, '')")} < 0.8 THEN 'train' ELSE 'eval' END AS part FROM s"
    ),
    "split_exact_scattered_ids": (
        "WITH n AS (SELECT count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k FROM orders) "
        "SELECT 'train' AS part, k AS n, k AS orders FROM n UNION ALL SELECT 'eval', n - k, n - k FROM n"
    ),
    "complement_scattered_ids": (
        "SELECT o_custkey % 1000 AS id, o_orderkey FROM orders WHERE o_custkey % 10 <> 0 AND o_custkey % 1000 >= 500"
    ),
    "complement_by_id": f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_DRAW} >= 0.8",
    "complement_by_set": f"WITH {_TRAIN} SELECT o_custkey, o_orderstatus FROM orders EXCEPT SELECT o_custkey, o_orderstatus FROM t",
    "ordinal_encode": "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INT) AS code FROM orders",
    "ordinal_encode_many": "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) AS INT) AS code FROM customer",
    "row_numbers": "SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders",
    "value_ranks": (
        "WITH r AS (SELECT l_extendedprice AS x, rank() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem) "
        "SELECT x, count(*) AS n, rank FROM r GROUP BY x, rank"
    ),
    "value_ranks_chunked": (
        "WITH r AS (SELECT l_extendedprice AS x, rank() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem) "
        "SELECT x, count(*) AS n, rank FROM r GROUP BY x, rank"
    ),
    "number_rows_taken_names": (
        "SELECT o_orderkey AS _seen, o_totalprice AS _place, o_custkey AS _part, o_orderstatus AS _start, "
        "row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders"
    ),
    "category_levels": " UNION ALL ".join(
        f"SELECT '{c}' AS f, CAST(row_number() OVER (ORDER BY {c}) AS INT) AS position, {c} AS level "
        f"FROM (SELECT DISTINCT {c} FROM orders)"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "table_rows": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    ),
    "table_columns": (
        "SELECT CAST(row_number() OVER () AS INT) AS position, column_name AS name, column_type = 'VARCHAR' AS categorical, n "
        "FROM (DESCRIBE lineitem), (SELECT count(*) AS n FROM lineitem)"
    ),
    "lookup_by_id": (
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1"
    ),
    "unions": (
        "SELECT 'distinct' AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM "
        "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) UNION ALL "
        "SELECT 'all', count(*), CAST(sum(k) AS BIGINT) FROM "
        "(SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)"
    ),
    "left_join": "SELECT doc_id, n_chars, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
}
