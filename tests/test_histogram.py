import math

import pytest
from pyspark.sql import functions as F

from statloom import MDH, fit_histogram
from statloom.operators import joins
from statloom.operators.quantile import equal_width_buckets
from statloom.plans import histogram
from statloom.plans.histogram import rank_features


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, float(i), "p" if i < 6 else "q", "A" if i < 4 else "B") for i in range(12)]
    return spark.createDataFrame(rows, "id int, x double, c string, y string")


def test_cells_cover_every_row(small):
    model = fit_histogram(small, "y", ["c"], ["x"], 3)
    assert model.cells.agg(F.sum("nxy")).first()[0] == 12
    assert model.rows == 12 and model.majority == "B"
    assert [(b.xq, b.mn, b.mx, b.n) for b in model.buckets["x"]] == [(1, 0, 3, 4), (2, 4, 7, 4), (3, 8, 11, 4)]
    assert model.contingency().count() == model.cells.count()
    assert math.isclose(model.density_1d("x").agg(F.sum("p")).first()[0], 1.0)
    assert math.isclose(model.density_1d("c").agg(F.sum("p")).first()[0], 1.0)
    assert math.isclose(model.density_2d("x", "c").agg(F.sum("p")).first()[0], 1.0)
    with pytest.raises(ValueError):
        model.density_2d("c", "x")


@pytest.mark.parametrize("broadcast_rows", [1_000, 0])
def test_new_rows(small, spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(histogram, "BROADCAST_ROWS", broadcast_rows)
    model = fit_histogram(small, "y", ["c"], ["x"], 3)
    rows = [(1, -9.0, "p"), (2, 99.0, "q"), (3, 1.0, "new"), (4, None, "p"), (5, 5.0, None), (6, 3.5, "p")]
    new = spark.createDataFrame(rows, "id int, x double, c string")
    found = {r.id: (r.prediction, r.matched) for r in model.predict(new).collect()}
    assert found == {1: ("A", True), 2: ("B", True), 3: ("B", False), 4: ("B", False), 5: ("B", False), 6: ("A", True)}
    each = model.density(new).groupBy("id").agg(F.count("*").alias("n"), F.max("measure").alias("m")).collect()
    assert {r.id: (r.n, r.m) for r in each}[3] == (1, None)
    assert {r.id: r.n for r in each} == {i: 1 for i in range(1, 7)}


def test_tied_classes_give_one_row(spark):
    frame = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", "b"), ("m", "a")], "c string, y string")
    predicted = fit_histogram(frame, "y", ["c"], [], 2).predict(frame)
    assert [r.prediction for r in predicted.collect()] == ["a"] * 4


def test_default_features_leave_the_target_out(spark):
    frame = spark.createDataFrame([(1.0, 2, 0), (2.0, 3, 1)], "a double, b int, y int")
    assert fit_histogram(frame, "y", [], None, 2).numeric == ["a", "b"]


def test_ranking(spark):
    frame = spark.createDataFrame([(float(i), "u" if i % 2 else "v", "c", i // 8) for i in range(16)], "x double, odd string, one string, y int")
    found = [(r.f, round(r.mi, 9)) for r in rank_features(frame, ["odd", "one"], ["x"], 2, "y").collect()]
    assert found[0] == ("x", 1.0)
    assert {f: v + 0.0 for f, v in found[1:]} == {"odd": 0.0, "one": 0.0}
    assert rank_features(frame, [], ["x"], 2, "y").count() == 1


def test_whole_flow(small, spark):
    small.createOrReplaceTempView("small_rows")
    mdh = MDH(spark, "small_rows", "y", ratio=0.7)
    with pytest.raises(RuntimeError):
        mdh.predict()
    mdh.train_test_split("id").estimate(["c"], 3, ["x"]).predict()
    assert mdh.train.count() + mdh.evaluation.count() == 12
    assert mdh.accuracy().first()["cases"] == mdh.evaluation.count()
    assert mdh.get_cat_feat() == ["c"] and mdh.get_num_feat() == ["x"]
    assert mdh.rank(None, ["c"], ["x"], 3).count() == 2
    assert mdh.visualize1D("x").columns == ["xq", "mn", "mx", "x_", "bin", "y", "p", "p_given_y"]
    assert mdh.visualize2D("x", "c").count() > 0
    assert mdh.density(small).count() >= 12
    assert joins.BROADCAST_ROWS == 200_000


def test_edges_of_equal_width(spark):
    frame = spark.createDataFrame([(float(x), None if x == 3 else "a") for x in (0, 1, 2, 3, 9, 10)] + [(None, "b")], "x double, y string")
    model = fit_histogram(frame, "y", [], ["x"], 5, edges="width")
    assert [(b.xq, b.mn, b.mx, b.n) for b in model.buckets["x"]] == [(1, 0.0, 1.0, 2), (2, 2.0, 2.0, 1), (5, 9.0, 10.0, 2)]
    assert equal_width_buckets(frame.where("x IS NULL"), ["x"], 3) == {"x": []}
    with pytest.raises(ValueError):
        fit_histogram(frame, "y", [], ["x"], 5, edges="other")
    with pytest.raises(ValueError):
        model.density(frame, ["z"])
