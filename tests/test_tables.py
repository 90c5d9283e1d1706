"""Splits, encodings, joins, ranks and sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators.encode import apply_ordinal, number_rows, ordinal
from statloom.operators.joins import fits_broadcast, lookup_join
from statloom.operators.quantile import Bucket, equal_frequency_buckets, equal_width, quantise, value_ranks
from statloom.operators.split import bernoulli_split, complement, exact_split, set_complement
from statloom.session import small_frame
from statloom.sources import tables


def ids(frame, column="id"):
    return sorted(r[column] for r in frame.select(column).collect())


@pytest.mark.parametrize("hash_name", ["xxhash64", "md5"])
def test_bernoulli_split_is_a_partition(spark, hash_name):
    frame = spark.range(2000)
    train, rest = bernoulli_split(frame, 0.7, 3, "id", hash_name)
    assert ids(train.union(rest)) == list(range(2000))
    assert 1300 < train.count() < 1500
    again, _ = bernoulli_split(frame.repartition(7), 0.7, 3, "id", hash_name)
    assert ids(again) == ids(train)


def test_split_without_id_is_pinned(spark):
    train, rest = bernoulli_split(spark.range(500), 0.5, 1)
    assert ids(train.union(rest)) == list(range(500))


@pytest.mark.parametrize("take_rows", [5, 100_000])
def test_exact_split_has_the_exact_size(spark, take_rows):
    frame = spark.range(1001)
    train, rest = exact_split(frame, "id", 0.8, 1, take_rows=take_rows)
    assert train.count() == 801
    assert ids(train.union(rest)) == list(range(1001))
    assert ids(train) == ids(exact_split(frame, "id", 0.8, 1)[0])
    assert exact_split(frame, "id", 0.0)[0].count() == 0
    assert exact_split(frame, "id", 1.0)[1].count() == 0


def test_complements_treat_copies_differently(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "id int, v string")
    part = frame.where("id = 1")
    assert ids(complement(frame, part, "id")) == [2, 3, 4, 5]
    assert ids(set_complement(frame.select("v"), part.select("v")), "v") == ["b", "c"]


def test_ordinals(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,), ("c's",)], "v string")
    assert [r.code for r in ordinal(frame, ["v"], {"v": "code"}).collect()] == [2, 1, None, 3]
    assert apply_ordinal(frame, "v", ["a"], "code").where("v = 'b'").first()["code"] is None
    many = spark.range(300).select(F.format_string("v%03d", "id").alias("v"), "id")
    coded = ordinal(many, ["v"])
    assert coded.where("v != id + 1").count() == 0 and coded.schema["v"].dataType.simpleString() == "int"


def test_row_numbers_are_dense_despite_copies(spark):
    frame = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("v"))
    numbered = number_rows(frame, ["v"], "i").orderBy("i").collect()
    assert [r.i for r in numbered] == list(range(1, 1001))
    assert [r.v for r in numbered] == sorted(r.v for r in frame.collect())


def test_lookup_join_with_hot_and_missing_keys(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 500).cast("int").alias("k"),
        (F.col("id") % 2).cast("int").alias("m"),
    )
    table = spark.range(800).select((F.col("id") / 2).cast("int").alias("k"), (F.col("id") % 2).cast("int").alias("m"), F.col("id").alias("w"))
    expected = sorted(map(str, rows.join(table, ["k", "m"], "left").select("id", "k", "m", "w").collect()))
    for limit, hot in ((10_000, 4), (10, 4), (10, 1)):
        found = lookup_join(rows, table, ["k", "m"], broadcast_rows=limit, hot_keys=hot)
        assert sorted(map(str, found.select("id", "k", "m", "w").collect())) == expected


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    frame = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array("id", "id").alias("pair"))
    assert fits_broadcast(frame) and fits_broadcast(frame, 100)
    assert not fits_broadcast(frame, 99) and not fits_broadcast(frame, 100, 90_000)
    assert fits_broadcast(frame.limit(0), 0, 0)


def test_ties_share_a_bucket(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "x double")
    buckets = equal_frequency_buckets(frame, ["x"], 3)
    assert buckets["x"] == [Bucket(1, 1, 1, 1), Bucket(2, 2, 2, 2), Bucket(3, 4, 4, 1)]
    assert sorted(r.q for r in quantise(frame, buckets, {"x": "q"}).collect()) == [1, 2, 2, 3]


def test_gaps_and_ends_belong_to_the_lower_bucket(spark):
    buckets = equal_frequency_buckets(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "x double"), ["x"], 2)
    new = spark.createDataFrame([(-5.0,), (5.0,), (99.0,), (None,), (float("nan"),), (10.0,)], "x double")
    assert [r.q for r in quantise(new, buckets, {"x": "q"}).collect()] == [1, 1, 2, None, None, 2]


@pytest.mark.parametrize("chunk_rows", [50, 10**6])
def test_buckets_and_ranks_are_exact_in_chunks(spark, chunk_rows):
    generator = np.random.default_rng(5)
    values = np.where(generator.random(3000) < 0.4, 42.0, np.round(generator.normal(40, 9, 3000), 2))
    frame = spark.createDataFrame(pd.DataFrame({"x": values, "z": -values}))
    for column in ("x", "z"):
        series = pd.Series(frame.select(column).toPandas()[column])
        expected = np.ceil(17 * series.rank(method="min") / len(series)).astype(int)
        buckets = equal_frequency_buckets(frame, ["x", "z"], 17, chunk_rows)[column]
        found = quantise(frame, {column: buckets}, {column: "q"}).toPandas()["q"]
        assert (found == expected).all()
        for b in buckets:
            inside = series[expected == b.xq]
            assert (b.mn, b.mx, b.n) == (inside.min(), inside.max(), len(inside))
    ranks = value_ranks(frame, "x", chunk_rows).toPandas().set_index("x").sort_index()
    expected = pd.Series(values).rank(method="min").groupby(values).agg(["min", "size"])
    assert (ranks["rank"] == expected["min"]).all() and (ranks["n"] == expected["size"]).all()


def test_empty_and_constant_columns(spark):
    frame = spark.createDataFrame([(None, 3.0), (None, 3.0)], "e double, c double")
    buckets = equal_frequency_buckets(frame, ["e", "c"], 4)
    assert buckets == {"e": [], "c": [Bucket(2, 3.0, 3.0, 2)]}
    row = equal_width(frame, ["e", "c"], 4, {"e": "we", "c": "wc"}).first()
    assert (row.we, row.wc) == (None, 1)


def test_equal_width_ends(spark):
    frame = spark.createDataFrame([(0.0,), (2.5,), (9.99,), (10.0,)], "x double")
    assert [r.w for r in equal_width(frame, ["x"], 4, {"x": "w"}).collect()] == [1, 2, 4, 4]


def test_csv_and_names(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id,kind,value\n1,a,0.5\n2,b,1.5\n")
    read = tables.read_csv(spark, str(path), "id int, kind string, value double")
    assert [tuple(r) for r in read.collect()] == [(1, "a", 0.5), (2, "b", 1.5)]
    assert dict(tables.read_csv(spark, str(path)).dtypes)["value"] == "double"
    tables.register(spark, read, "demo_model")
    tables.register(spark, pd.DataFrame({"a": [1]}), "demo_other")
    assert tables.tables_like(spark, "*model") == ["demo_model"]
    assert tables.run(spark, "SELECT sum(value) AS s FROM demo_model", as_pandas=True)["s"][0] == 2.0
    tables.drop(spark, "demo_model")
    tables.drop(spark, "demo_other")
    assert tables.tables_like(spark, "demo*") == []
    assert tables.append_rows(read, [(3, "c", 2.0)]).count() == 3
    assert tables.empty_like(read).count() == 0 and tables.empty_like(read).columns == read.columns
    assert tables.lookup(read, "id", 2).first()["kind"] == "b"
    assert tables.scan(read, ["kind"]).columns == ["kind"]
    assert [r.categorical for r in tables.column_types(read).orderBy("position").collect()] == [False, True, False]
    tables.write_text(spark, "one\ntwo", str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["one", "two"]


def test_stored_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE stored LOCATION '{tmp_path}/stored'")
    try:
        for top in (3, 5):
            found = tables.materialise(spark, "stored.numbers", f"SELECT id FROM range({top})")
            assert found.count() == top
        tables.register(spark, spark.range(4), "stored.others", saved=True)
        assert spark.table("stored.others").count() == 4
        tables.drop(spark, "stored.others")
        assert not spark.catalog.tableExists("stored.others")
    finally:
        spark.sql("DROP DATABASE stored CASCADE")


def test_jdbc_options():
    found = tables.jdbc_options("mysql", "shop", "orders", "db", user="me", password="pw")
    assert found["url"] == "jdbc:mysql://db:3306/shop" and found["dbtable"] == "orders" and found["user"] == "me"
    assert tables.jdbc_options("mssql", "shop", "t")["url"] == "jdbc:sqlserver://localhost:1433;databaseName=shop"
    assert tables.jdbc_options("sqlite", "/data/x.db", "t")["url"] == "jdbc:sqlite:/data/x.db"
    with pytest.raises(ValueError):
        tables.jdbc_options("other", "x", "t")


def test_small_frame_is_local(spark):
    frame = small_frame(spark, [(1, [1.5], None)], "a int, b array<double>, c string")
    assert "LocalTableScan" in frame._jdf.queryExecution().executedPlan().toString()
    assert tuple(frame.first()) == (1, [1.5], None)
    assert small_frame(spark, [], "a int").count() == 0
