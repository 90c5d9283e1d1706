"""Classes used from start to end: saved, loaded, stopped and resumed models, and tables that are written, updated and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.catalog import clustering, gaussian
from statloom.catalog.common import load, rounded
from statloom.plans.gaussian import GaussianClassifier
from statloom.plans.histogram import MultidimensionalHistogram
from statloom.plans.kmeans import KMeans, start_rows
from statloom.plans.tree import DecisionTreeClassifier
from statloom.session import shared_folder, small_frame
from statloom.sources.published import PublishedTable
from statloom.sources.registry import ModelRegistry
from statloom.sources.tables import append_rows, drop, empty_like, read_csv, register, run, write_text

STOPPED_STEPS = 40
SUPPLIER, PART = clustering.SUPPLIER, clustering.PART


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4()}"


def kmeans_saved(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of a model that was fitted, saved and loaded under its name."""
    part, base = load(spark, d, "part"), _folder(spark, "models")
    start = clustering.first_rows(part, "p_partkey", PART, 3)
    KMeans(spark, base).create_model(part, PART, 3, "parts", "z-score", start=start).estimate(3)
    return rounded(KMeans(spark, base).load_model("parts").centroid_table(), value=8)


def kmeans_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the saved models after one of them was dropped."""
    part, base = load(spark, d, "part"), _folder(spark, "models")
    start = clustering.first_rows(part, "p_partkey", PART, 2)
    factory = KMeans(spark, base)
    for name in ("kept", "gone", "last"):
        factory.create_model(part, PART, 2, name, start=start)
    factory.drop_model("gone")
    return small_frame(spark, [(n,) for n in factory.get_model_names()], "name string")


def kmeans_resumed(spark: SparkSession, d: str) -> DataFrame:
    """One step, and two more after the model was loaded again: the same as three."""
    part, base = load(spark, d, "part"), _folder(spark, "models")
    start = clustering.first_rows(part, "p_partkey", PART, 3)
    KMeans(spark, base).create_model(part, PART, 3, "parts", "z-score", start=start).estimate(1)
    return rounded(KMeans(spark, base).load_model("parts", part).estimate(2).centroid_table(), value=8)


def kmeans_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Steps until the variance stays the same, well before the most allowed."""
    supplier = load(spark, d, "supplier")
    start = clustering.first_rows(supplier, "s_suppkey", SUPPLIER, 2)
    model = KMeans(spark).create_model(supplier, SUPPLIER, 2, "supplier", "z-score", start=start).estimate(500)
    if model.steps >= 500:
        raise RuntimeError("the variance never stayed the same")
    return rounded(model.centroid_table(), value=6)


def kmeans_starts(spark: SparkSession, d: str) -> DataFrame:
    """Seeded start rows: as many as asked, all different, all rows of the table."""
    points = load(spark, d, "customer").select(*[F.col(c).cast("double").alias(c) for c in clustering.CUSTOMER])
    chosen = small_frame(spark, [tuple(map(float, r)) for r in start_rows(points, 5, 7)], "c_acctbal double, c_nationkey double")
    known = chosen.join(points.distinct(), clustering.CUSTOMER, "left_semi").count()
    return chosen.agg(F.count("*").alias("n"), F.count_distinct(*clustering.CUSTOMER).alias("different"), F.lit(known).cast("long").alias("known"))


def gaussian_saved(spark: SparkSession, d: str) -> DataFrame:
    """A classifier saved with its quality, loaded and used on the same rows; predictions beside targets."""
    part, base = load(spark, d, "part"), _folder(spark, "models")
    made = GaussianClassifier(spark, base).create_model(part, gaussian.TWO, "p_type", "types", multivariate=False)
    made.estimate(ratio=None).predict().score()
    again = GaussianClassifier(spark, base).load_model("types").predict(part)
    found = again.predictions.select("p_partkey", "y_prediction", "probability", F.lit(again.get_accuracy()).alias("accuracy"))
    return rounded(found, probability=12, accuracy=10)


def gaussian_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and targets read back, as counts of each."""
    part = load(spark, d, "part")
    made = GaussianClassifier(spark).estimate(part, gaussian.TWO, "p_type", multivariate=False, ratio=None).predict()
    predicted = made.get_prediction_array().groupBy(F.col("y_prediction").alias("label")).agg(F.count("*").alias("n"))
    targets = made.get_target_array().groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
    return predicted.withColumn("kind", F.lit("prediction")).unionByName(targets.withColumn("kind", F.lit("target")))


def _parts(train: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Rows whose part is lost, doubled or shared, and the size of the training part in hundredths, roughly."""
    both = train.select(key, F.lit(1).alias("t")).unionByName(rest.select(key, F.lit(0).alias("t")))
    per_row = both.groupBy(key).agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    return per_row.agg(F.count("*").alias("orders"), F.sum("n").alias("n"), (F.abs(F.sum("t") / F.sum("n") - 0.8) < 0.05).alias("near"))


def gaussian_split(spark: SparkSession, d: str) -> DataFrame:
    """The class's own seeded split keeps every row once."""
    orders = load(spark, d, "orders")
    made = GaussianClassifier(spark, _folder(spark, "models")).create_model(orders, ["o_totalprice"], "o_orderstatus", "orders")
    made.train_test_split(0.8, 3, "o_orderkey")
    return _parts(made.train, made.evaluation, "o_orderkey")


def tree_split(spark: SparkSession, d: str) -> DataFrame:
    """An exact split with categories encoded as ordinals, which are features then."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    tree = DecisionTreeClassifier(spark).initialize(orders, features=["o_totalprice", "o_orderpriority"])
    tree.train_test_split(0.8, 1, encode=True, id_col="o_orderkey", exact=True)
    halves = tree.train.withColumn("part", F.lit("train")).unionByName(tree.evaluation.withColumn("part", F.lit("eval")))
    features = F.lit(",".join(tree.numeric))
    codes = [F.min("o_orderpriority").cast("int").alias("least"), F.max("o_orderpriority").cast("int").alias("most")]
    return halves.groupBy("part").agg(F.count("*").alias("n"), *codes).withColumn("features", features)


def histogram_class(spark: SparkSession, d: str) -> DataFrame:
    """The class's features, and how many rows its model holds."""
    made = MultidimensionalHistogram(spark, load(spark, d, "orders"), "o_orderstatus")
    made.estimate(["o_orderpriority"], 10, ["o_totalprice", "o_custkey"])
    rows = [("categorical", f, made.model.rows) for f in made.get_cat_feat()] + [("numeric", f, made.model.rows) for f in made.get_num_feat()]
    return small_frame(spark, rows, "kind string, feature string, n long")


def registry_list(spark: SparkSession, d: str) -> DataFrame:
    """Models of a registry after saves, a replacement and a drop; their parameters are rows of a table."""
    registry = ModelRegistry(spark, _folder(spark, "registry"), "kind")
    nation = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    ids = {name: registry.new_id(name) for name in ("a", "b", "c")}
    for name, region in (("a", 0), ("b", 1), ("c", 2), ("a", 3)):
        registry.save(ids[name], {"name": name, "state": region}, nation.where(F.col("n_regionkey") == region))
    registry.drop("b")
    parts = [registry.params(m["id"]).agg(F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("total")).select(F.lit(m["name"]).alias("name"), F.lit(m["state"]).cast("long").alias("state"), "n", "total") for m in registry.entries()]
    return parts[0].unionByName(parts[1])


def table_updated(spark: SparkSession, d: str) -> DataFrame:
    """Orders published, some prices changed, some orders added and some removed, read back."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    table = PublishedTable(spark, _folder(spark, "published")).write(orders, ["o_orderkey"])
    dearer = orders.where("o_orderkey % 10 = 3").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = orders.where("o_orderkey % 10 = 4").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    table.update(dearer).update(added).remove(orders.where("o_orderkey % 10 = 5").select("o_orderkey"))
    return table.read().fillna(-1, ["o_custkey", "o_totalprice"])


def table_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A reader of the old version goes on while the next one is published."""
    part, folder = load(spark, d, "part").select("p_partkey", "p_size"), _folder(spark, "published")
    table = PublishedTable(spark, folder).write(part.where("p_size <= 20"), ["p_partkey"])
    before = table.read()
    PublishedTable(spark, folder).write(part.where("p_size > 20"), ["p_partkey"])
    after = PublishedTable(spark, folder).read()
    return before.withColumn("version", F.lit("old")).unionByName(after.withColumn("version", F.lit("new")))


def csv_back(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as CSV with a header and read with inferred types."""
    path = _folder(spark, "csv")
    load(spark, d, "supplier").write.option("header", True).csv(path)
    return read_csv(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal")


def named_table(spark: SparkSession, d: str) -> DataFrame:
    """A frame named as a table, queried by a statement, and removed; with rows appended to an empty copy of it."""
    name = f"parts_{uuid.uuid4().hex}"
    register(spark, load(spark, d, "part").select("p_partkey", "p_size"), name)
    found = run(spark, f"SELECT p_size, count(*) AS n FROM {name} GROUP BY p_size")
    added = append_rows(empty_like(found), [(0, 1), (-1, 2)])
    drop(spark, name)
    if spark.catalog.tableExists(name):
        raise RuntimeError("the table is still there")
    return found.unionByName(added)


def text_back(spark: SparkSession, d: str) -> DataFrame:
    """A tree's text written to a folder of text files; its lines, read again."""
    part, path = load(spark, d, "part"), _folder(spark, "text")
    tree = DecisionTreeClassifier(spark).initialize(part.select("p_size", "p_type"), "p_type")
    text = tree.estimate(max_depth=1).create_model(path)
    write_text(spark, text, f"{path}-again")
    lines = spark.read.text(path).withColumn("source", F.lit("model")).unionByName(spark.read.text(f"{path}-again").withColumn("source", F.lit("text")))
    whens = F.sum(F.startswith("value", F.lit("WHEN ")).cast("int")).alias("leaves")
    return lines.groupBy("source").agg(F.count("*").alias("lines"), whens)


_STEPS = clustering._steps
_LONG = clustering._long
_UNI = gaussian.ORACLES["gaussian_univariate_predict"]
_SPLIT = "SELECT count(*) AS orders, CAST(count(*) AS BIGINT) AS n, true AS near FROM orders"

QUERIES = {
    "kmeans_saved": kmeans_saved,
    "kmeans_saved_names": kmeans_names,
    "kmeans_resumed": kmeans_resumed,
    "kmeans_stopped": kmeans_stopped,
    "kmeans_start_rows": kmeans_starts,
    "gaussian_saved_predict": gaussian_saved,
    "gaussian_read_back": gaussian_arrays,
    "gaussian_split": gaussian_split,
    "tree_split_encoded": tree_split,
    "histogram_features": histogram_class,
    "registry_models": registry_list,
    "table_updated": table_updated,
    "table_replaced": table_replaced,
    "csv_round_trip": csv_back,
    "named_table": named_table,
    "text_round_trip": text_back,
}

ORACLES = {
    "kmeans_saved": f"WITH {_STEPS('part', 'p_partkey', PART, 3, 3)} {_LONG('c3', 2)}",
    "kmeans_resumed": f"WITH {_STEPS('part', 'p_partkey', PART, 3, 3)} {_LONG('c3', 2)}",
    "kmeans_saved_names": "SELECT * FROM (VALUES ('kept'), ('last')) AS v(name) WHERE (SELECT count(*) FROM part) >= 2",
    "kmeans_stopped": f"WITH {_STEPS('supplier', 's_suppkey', SUPPLIER, 2, STOPPED_STEPS)} {_LONG(f'c{STOPPED_STEPS}', 2).replace(', 8)', ', 6)')}",
    "kmeans_start_rows": (
        "SELECT least(5, count(*)) AS n, least(5, count(DISTINCT (c_acctbal, c_nationkey))) AS different, least(5, count(*)) AS known FROM customer"
    ),
    "gaussian_saved_predict": (
        f"WITH f AS ({_UNI}), g AS (SELECT avg(CAST(p_type = y_prediction AS INT)) AS accuracy FROM f JOIN part USING (p_partkey)) "
        "SELECT p_partkey, y_prediction, probability, round(accuracy, 10) AS accuracy FROM f, g"
    ),
    "gaussian_read_back": (
        f"WITH f AS ({_UNI}) SELECT y_prediction AS label, count(*) AS n, 'prediction' AS kind FROM f GROUP BY 1 "
        "UNION ALL SELECT p_type, count(*), 'target' FROM part GROUP BY 1"
    ),
    "gaussian_split": _SPLIT,
    "tree_split_encoded": (
        "WITH n AS (SELECT count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k, CAST(count(DISTINCT o_orderpriority) AS INT) AS p FROM orders) "
        "SELECT 'train' AS part, k AS n, CAST(1 AS INT) AS least, p AS most, 'o_totalprice,o_orderpriority' AS features FROM n "
        "UNION ALL SELECT 'eval', n - k, 1, p, 'o_totalprice,o_orderpriority' FROM n"
    ),
    "histogram_features": (
        "SELECT kind, feature, (SELECT count(*) FROM orders) AS n FROM (VALUES ('categorical', 'o_orderpriority'), "
        "('numeric', 'o_totalprice'), ('numeric', 'o_custkey')) AS v(kind, feature)"
    ),
    "registry_models": (
        "SELECT v.name, CAST(v.state AS BIGINT) AS state, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total "
        "FROM (VALUES ('a', 3), ('c', 2)) AS v(name, state) JOIN nation ON n_regionkey = v.state GROUP BY v.name, v.state"
    ),
    "table_updated": (
        "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus "
        "FROM orders WHERE o_orderkey % 10 <> 5 UNION ALL SELECT -o_orderkey - 1, -1, -1, 'N' FROM orders WHERE o_orderkey % 10 = 4"
    ),
    "table_replaced": "SELECT p_partkey, p_size, CASE WHEN p_size <= 20 THEN 'old' ELSE 'new' END AS version FROM part",
    "csv_round_trip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "named_table": "SELECT p_size, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT 0, 1 UNION ALL SELECT -1, 2",
    "text_round_trip": (
        "SELECT source, CAST(5 AS BIGINT) AS lines, CAST(2 AS BIGINT) AS leaves FROM (VALUES ('model'), ('text')) AS v(source) "
        "WHERE (SELECT count(*) FROM part) > 1"
    ),
}
