import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression as MLRegression
from pyspark.sql import functions as F

from statloom import LinearRegression, fit_linear
from statloom.functions.metrics import r2
from statloom.operators import moments


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, float(i % 7), float((i * 5) % 11), ["a", "b", "c"][i % 3]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, x1 double, x2 double, kind string")
    return frame.withColumn("y", 2 + 3 * F.col("x1") - F.col("x2") + F.when(F.col("kind") == "b", 5.0).otherwise(0.0))


def test_missing_values_drop_the_row(spark):
    rows = [(1.0, 1.0, 3.0), (2.0, 5.0, 7.0), (3.0, 2.0, 5.0), (4.0, 0.0, 4.0), (None, 1.0, 90.0), (1.0, None, 90.0), (1.0, 1.0, None), (float("nan"), 1.0, 9.0)]
    frame = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    full = np.array(rows[:4])
    expected = np.linalg.lstsq(np.column_stack([np.ones(4), full[:, :2]]), full[:, 2], rcond=None)[0]
    assert np.allclose(fit_linear(frame, ["x1", "x2"], "y").coefficients, expected)


def test_agrees_with_ml(lines):
    model = fit_linear(lines, ["x1", "x2"], "y")
    vectors = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(lines)
    other = MLRegression(labelCol="y", solver="normal").fit(vectors)
    assert np.allclose(model.coefficients, [other.intercept, *other.coefficients])
    assert np.isclose(r2(model.transform(lines), "y", "y_prediction").first()["r2"], other.summary.r2)


def test_collinear_features_get_the_minimum_norm(spark):
    frame = spark.createDataFrame([(float(i), 2.0 * i, 5.0 * i) for i in range(6)], "x1 double, x2 double, y double")
    assert np.allclose(fit_linear(frame, ["x1", "x2"], "y").coefficients, [0, 1, 2])


def test_one_hot_keeps_levels_of_the_fit(lines, spark):
    model = fit_linear(lines, ["x1", "x2", "kind"], "y", encode=True)
    assert model.features == ["x1", "x2", "linreg_ohe_kind_a", "linreg_ohe_kind_b", "linreg_ohe_kind_c"]
    worst = model.transform(lines).select(F.max(F.abs(F.col("y") - F.col("y_prediction")))).first()[0]
    assert worst < 1e-9
    new = spark.createDataFrame([(0.0, 0.0, "never seen")], "x1 double, x2 double, kind string")
    assert np.isclose(model.transform(new).first()["y_prediction"], model.coefficients[0])
    reduced = fit_linear(lines, ["x1", "x2", "kind"], "y", encode=True, drop_first=True)
    assert np.isclose(reduced.transform(new).first()["y_prediction"], 2.0)


def test_text_needs_one_hot(lines):
    with pytest.raises(ValueError, match="one-hot"):
        fit_linear(lines, ["kind"], "y")


def test_wide_sums_equal_expressions(lines, monkeypatch):
    narrow = moments.gram(lines, ["x1", "x2", "y"])
    monkeypatch.setattr(moments, "EXPRESSION_COLUMNS", 1)
    assert np.allclose(moments.gram(lines, ["x1", "x2", "y"]), narrow)


def test_many_columns_stay_cheap_to_plan(spark):
    names = [f"c{i}" for i in range(12)]
    frame = spark.range(200).select(*[(F.rand(i) + F.col("id") * 0).alias(n) for i, n in enumerate(names)])
    assert len(fit_linear(frame, names[1:], "c0").coefficients) == 12


def test_constant_target_has_no_score(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert r2(fit_linear(frame, ["x"], "y").transform(frame), "y", "y_prediction").first()["r2"] is None


def test_saved_models(lines, spark, tmp_path):
    lr = LinearRegression(spark, str(tmp_path))
    assert lr.get_model_list().count() == 0
    with pytest.raises(RuntimeError):
        lr.predict()
    lr.create_model(lines, ["x1", "x2", "kind"], "y", "body").estimate().predict().score()
    assert lr.get_score() > 0.999
    assert "body (m1)" in lr.get_active_model_description()
    with pytest.raises(ValueError, match="exists"):
        lr.create_model(lines, ["x1"], "y", "body")
    lr.estimate(lines, ["x1"], "y")
    assert [tuple(r) for r in lr.get_model_list().collect()] == [("m0", "m0", 1), ("m1", "body", 3)]

    other = LinearRegression(spark, str(tmp_path)).load_model("body")
    assert other.get_score() > 0.999
    assert len(other.get_coefficients()) == 6
    renamed = lines.withColumnRenamed("x1", "first")
    found = other.predict(renamed, ["first", "x2", "kind"]).get_prediction_array()
    assert found.count() == 60 and found.columns == ["y_prediction"]
    with pytest.raises(ValueError, match="3 columns"):
        other.predict(renamed, ["first"])
    other.drop_model("m1")
    with pytest.raises(KeyError):
        other.load_model("body")


def test_log_level(spark):
    LinearRegression(spark).set_log_level("DEBUG")
    LinearRegression(spark).set_log_level("NONE")
    with pytest.raises(ValueError):
        LinearRegression(spark).set_log_level("LOUD")
