"""Cases beyond the named queries: large values, many features, missing cells, taken names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import fit_gaussian, fit_histogram, fit_linear
from statloom.operators.encode import ordinal
from statloom.operators.matrix import multiply_matrices
from statloom.operators.moments import grouped_moments
from statloom.operators.split import bernoulli_split, complement, exact_split


def test_wide_moments_of_far_classes(spark):
    draw = np.random.default_rng(0)
    rows = [("near", *map(float, draw.normal(0, 1, 9))) for _ in range(50)] + [("far", *map(float, 1e8 + draw.normal(0, 1, 9))) for _ in range(50)]
    names = [f"x{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ["k", *names]).repartition(3)
    for group in grouped_moments(df, names, "k", diagonal=False):
        own = np.array([r[1:] for r in rows if r[0] == group.key])
        assert group.n == 50 and group.cov == pytest.approx(np.cov(own.T, bias=True), abs=1e-6)


def test_distances_of_many_features(spark):
    draw = np.random.default_rng(1)
    names = [f"x{i}" for i in range(20)]
    rows = [(i, "ab"[i % 2], *map(float, draw.normal(i % 2, 1, 20))) for i in range(200)] + [(999, "a", None, *[0.0] * 19)]
    df = spark.createDataFrame(rows, ["id", "y", *names])
    model = fit_gaussian(df, names, "y", multivariate=True)
    found = {(r["id"], r["y_class"]): r["distance"] for r in model.mahalanobis(df).collect()}
    assert len(found) == 402 and found[999, "a"] is None and found[999, "b"] is None
    c = model.classes[0]
    gap = np.array(rows[3][2:]) - c.mean
    assert found[3, c.label] == pytest.approx(gap @ c.precision @ gap)


def test_regression_far_from_the_origin(spark):
    df = spark.range(400).select((F.col("id") * 1_500_000).alias("x")).withColumn("y", 5 + F.col("x") * 2e-6)
    model = fit_linear(df, ["x"], "y")
    assert model.coefficients == pytest.approx([5.0, 2e-6], rel=1e-9)
    twice = fit_linear(df.withColumn("z", F.col("x") * 2), ["x", "z"], "y")
    assert twice.coefficients[0] == pytest.approx(5.0) and twice.coefficients[1] == pytest.approx(2e-6 / 5) and twice.coefficients[2] == pytest.approx(4e-6 / 5)


@pytest.mark.parametrize("times", [3, 7, 11])
def test_least_norm_beside_a_large_intercept(spark, times):
    df = spark.range(400).select((F.col("id") * 1_500_000).alias("x")).withColumn("y", 5e9 + F.col("x") * 2e-6).withColumn("z", F.col("x") * times)
    assert fit_linear(df, ["x", "z"], "y").coefficients == pytest.approx([5e9, 2e-6 / (1 + times**2), 2e-6 * times / (1 + times**2)], rel=1e-5)
    low = df.withColumn("one", F.lit(1.0)).withColumn("y", F.col("y") - 5e9 + 5)
    fixed = fit_linear(low, ["x", "z", "one"], "y").coefficients
    assert fixed == pytest.approx([2.5, 2e-6 / (1 + times**2), 2e-6 * times / (1 + times**2), 2.5], rel=1e-5)


def test_splits_of_missing_and_repeated_ids(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i % 7, i) for i in range(1000)], "id int, n int")
    for first, second in (bernoulli_split(df, 0.8, 1, "id"), bernoulli_split(df, 0.8, 1, "id", "md5"), exact_split(df, "id", 0.8)):
        assert sorted(r["n"] for r in first.union(second).collect()) == list(range(1000))
    assert exact_split(df, "id", 0.8)[0].count() == 800
    assert complement(df, df.where("id IS NULL"), "id").where("id IS NULL").count() == 0


@pytest.mark.parametrize("levels", [3, 100])
def test_ordinals_keep_the_order_of_columns(spark, levels):
    df = spark.createDataFrame([(i, f"s{i % levels}", i) for i in range(200)], "a int, s string, z int")
    assert ordinal(df, ["s"]).columns == ["a", "s", "z"]
    assert ordinal(df, ["s"], {"s": "code"}).columns == ["a", "s", "z", "code"]


def test_missing_cell_of_a_small_matrix(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0)], "id int, x1 double, x2 double")
    b = spark.createDataFrame([(1, None, 1.0), (2, 3.0, 4.0)], "id int, x1 double, x2 double")
    assert tuple(multiply_matrices(a, b).first()) == (1, None, 9.0)


def test_histograms_leave_out_rows_without_a_class(spark):
    df = spark.createDataFrame([("u", None)] * 5 + [("v", 1)] * 5 + [("u", 0)] * 5, "k string, y int")
    model = fit_histogram(df, "y", ["k"], [])
    assert model.majority == 0 and model.rows == 10
