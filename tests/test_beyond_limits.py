"""What has a way beyond the sizes that fit columns, one task or the driver, against the way within them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import KMeans, LinearRegression, fit_gaussian, fit_linear
from statloom.operators.encode import number_rows, one_hot_sparse, ordinal
from statloom.operators.joins import lookup_join
from statloom.operators.matrix import from_blocks, multiply_coordinates, salted, to_blocks, to_coordinates, transpose_blocks
from statloom.operators.quantile import cut_points
from statloom.plans.gaussian_table import fit_gaussian_table


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({"a": draw.normal(50, 9, 300), "g": draw.choice(list("pqrstu"), 300), "h": draw.choice(list("xyz"), 300)})
    frame["b"], frame["flat"] = frame["a"] * 2 + 1, 3.0
    frame["in_g"] = frame["g"].map({k: float(i) for i, k in enumerate("pqrstu")})
    frame["y"] = frame["a"] * 0.5 + frame["in_g"] ** 2 + (frame["h"] == "z") * 4 + draw.normal(size=300)
    frame.loc[frame.index % 37 == 0, "g"] = None
    return spark.createDataFrame(frame).withColumn("id", F.monotonically_increasing_id())


@pytest.mark.parametrize("drop_first", [False, True])
@pytest.mark.parametrize("x", [["g"], ["a", "g"], ["a", "b", "g", "flat"], ["g", "h", "a"], ["in_g", "g", "a"]])
def test_levels_in_a_table_fit_as_in_columns(spark, rows, x, drop_first):
    wide = fit_linear(rows, x, "y", encode=True, drop_first=drop_first)
    deep = fit_linear(rows, x, "y", encode=True, drop_first=drop_first, inline_levels=3)
    assert deep.absorbed == "g" and wide.absorbed is None
    expected = {n: v for _, n, v in wide.coefficient_rows()}
    found = {r["name"]: r["value"] for r in deep.coefficient_table(spark).collect()}
    assert found.keys() == expected.keys()
    for name, value in expected.items():
        assert found[name] == pytest.approx(value, abs=1e-7), name
    unseen = rows.withColumn("g", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("g"))).withColumn("_level", F.lit(1))
    pairs = [{r["id"]: r["y_prediction"] for r in m.transform(unseen).collect()} for m in (wide, deep)]
    assert all(pairs[0][i] == pytest.approx(pairs[1][i], abs=1e-7) for i in pairs[0])


def test_two_large_categories_are_refused(rows):
    with pytest.raises(ValueError, match="only one category"):
        fit_linear(rows, ["g", "h"], "y", encode=True, inline_levels=2)


def test_a_model_with_a_table_is_saved(spark, rows, tmp_path, monkeypatch):
    from statloom.plans import linear_regression

    monkeypatch.setattr(linear_regression.fit_linear, "__defaults__", (False, False, 3))
    fitted = LinearRegression(spark, str(tmp_path)).create_model(rows, ["a", "g"], "y", "deep").estimate()
    assert fitted.model.absorbed == "g"
    fitted.predict().score()
    again = LinearRegression(spark, str(tmp_path)).load_model("deep")
    first, second = ({r["id"]: r["y_prediction"] for r in m.predict(rows).predictions.collect()} for m in (fitted, again))
    assert first == second and again.get_score() == fitted.get_score()


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, v string")
    assert {r["id"]: (r["index"], r["size"]) for r in one_hot_sparse(df, "v").collect()} == {1: (1, 2), 2: (0, 2), 3: (None, 2), 4: (1, 2)}
    with pytest.raises(ValueError):
        one_hot_sparse(df.withColumn("index", F.lit(1)), "v")


@pytest.mark.parametrize("multivariate", [False, True])
def test_classes_in_a_table_predict_as_in_a_model(rows, multivariate, monkeypatch):
    from statloom.plans import gaussian_table

    monkeypatch.setattr(gaussian_table, "ROW_BLOCK", 40)
    monkeypatch.setattr(gaussian_table, "CLASS_NUMBERS", 20)
    known = rows.withColumn("_best", F.lit(1)).withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a")))
    one = fit_gaussian(known, ["a", "y"], "h", multivariate).transform(known)
    two = fit_gaussian_table(known, ["a", "y"], "h", multivariate).transform(known)
    assert two.columns == one.columns
    one, two = ({r["id"]: r for r in x.collect()} for x in (one, two))
    for i, r in one.items():
        assert two[i]["y_prediction"] == r["y_prediction"] and two[i]["_best"] == 1
        assert (r["probability"] is None) == (two[i]["probability"] is None)
        assert r["probability"] is None or two[i]["probability"] == pytest.approx(r["probability"], rel=1e-9)


def test_names_that_helpers_could_want(spark):
    names = ["_seen", "_place", "_part", "_start", "_rows", "_hot", "_code"]
    df = spark.createDataFrame([(*[i % 3] * 7, f"v{i % 80}") for i in range(200)], ", ".join(f"{n} int" for n in names) + ", v string")
    numbered = number_rows(df, ["v"], "i")
    assert numbered.columns == [*names, "v", "i"] and sorted(r.i for r in numbered.collect()) == list(range(1, 201))
    assert numbered.where("_part <> _seen OR _start <> _place").count() == 0
    table = df.select("v").distinct().withColumn("t", F.length("v"))
    joined = lookup_join(df, table, ["v"], broadcast_rows=1)
    assert sorted(joined.columns) == sorted([*names, "v", "t"]) and joined.where("t = length(v) AND _hot = _rows").count() == 200
    coded = ordinal(df, ["v"])
    assert coded.columns == df.columns and coded.where("_code = _hot").count() == 200


def test_blocks_hold_the_matrix(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(50, 7))
    df = spark.createDataFrame([(3 * i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"x{j} double" for j in range(7)))
    blocks = to_blocks(df, size=4)
    assert blocks.count() == 13 * 2
    back = {(r.i - 1, r.k - 1): r.v for r in from_blocks(blocks, 4).collect()}
    turned = {(r.i - 1, r.k - 1): r.v for r in from_blocks(transpose_blocks(blocks), 4).collect()}
    assert back == {(i, j): x[i, j] for i in range(50) for j in range(7)} and turned == {(j, i): v for (i, j), v in back.items()}


def test_salted_products_are_whole(spark):
    draw = np.random.default_rng(1)
    a = pd.DataFrame({"i": draw.integers(0, 60, 500), "k": np.where(draw.random(500) < 0.5, 0, draw.integers(0, 30, 500)), "va": draw.integers(1, 9, 500).astype(float)}).drop_duplicates(["i", "k"])
    b = pd.DataFrame({"k": np.where(draw.random(300) < 0.3, 0, draw.integers(0, 30, 300)), "j": draw.integers(0, 40, 300), "vb": draw.integers(1, 9, 300).astype(float)}).drop_duplicates(["k", "j"])
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    met = salted(left, right, 8)
    assert met.count() == len(a.merge(b, on="k"))
    assert met.where("k = 0").select("sl", "sr").distinct().count() > 4 and met.groupBy("k").agg(F.max("sl").alias("s")).where("s = 0").count() > 5
    product = multiply_coordinates(left.withColumnRenamed("va", "v"), right.withColumnRenamed("vb", "v"))
    summed = met.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, product.collect()))
    assert to_coordinates(spark.createDataFrame([(1, 2.0)], "id int, x double")).count() == 1


def test_cut_points_are_near_quantiles(spark):
    df = spark.range(200_000, numPartitions=9).select((F.xxhash64("id") % 1000003).cast("double").alias("x"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, 1.0).otherwise(float("nan")).alias("one"))
    cuts = cut_points(df, ["x", "none", "one"], 50)
    values = np.sort(df.select("x").toPandas()["x"].to_numpy())
    places = np.searchsorted(values, cuts["x"]) / len(values)
    assert len(cuts["x"]) == 49 and np.abs(places - np.arange(1, 50) / 50).max() < 0.005
    assert cuts["none"] == [] and cuts["one"] == [1.0]


def test_samples_do_not_follow_the_features(spark, rows):
    samples = []
    for names in (["a", "y"], ["y", "a"]):
        start = [[40.0, 20.0], [60.0, 40.0]] if names[0] == "a" else [[20.0, 40.0], [40.0, 60.0]]
        model = KMeans(spark).create_model(rows, names, 2, "s", start=start).estimate(1)
        order = ["x_0", "x_1"] if names[0] == "a" else ["x_1", "x_0"]
        samples.append(sorted(tuple(r) for r in model.cluster_sample(20).select(*order, "j").collect()))
    assert samples[0] == samples[1] and len(samples[0]) == 40
    lowest = sorted(r.a for r in rows.collect())[:20]
    assert len({s[0] for s in samples[0]} & set(lowest)) < 20
