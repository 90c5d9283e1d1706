import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import GaussianClassifier, fit_gaussian
from statloom.functions import scores
from statloom.operators import moments


@pytest.fixture(scope="module")
def points(spark):
    generator = np.random.default_rng(1)
    frames = [
        pd.DataFrame({"a": generator.normal(m, s, 80), "b": generator.normal(-m, 1, 80), "y": y})
        for y, m, s in (("A", 0, 1), ("B's", 4, 2))
    ]
    rows = pd.concat(frames, ignore_index=True)
    rows["id"] = range(len(rows))
    return spark.createDataFrame(rows)


def brute(rows, x, multivariate):
    logs = {}
    for y, group in rows.groupby("y"):
        z = group[x].to_numpy()
        cov = np.cov(z.T, bias=True).reshape(len(x), -1)
        if not multivariate:
            cov = np.diag(np.diag(cov))
        diff = rows[x].to_numpy() - z.mean(axis=0)
        distance = (diff @ np.linalg.inv(cov) * diff).sum(axis=1)
        logs[y] = np.log(len(group) / len(rows)) - 0.5 * (np.log(np.linalg.det(2 * np.pi * cov)) + distance)
    return pd.DataFrame(logs)


@pytest.mark.parametrize("multivariate", [False, True])
@pytest.mark.parametrize("in_batches", [False, True])
def test_scores_match_brute_force(points, multivariate, in_batches, monkeypatch):
    if in_batches:
        monkeypatch.setattr(scores, "QUADRATIC_TERMS", 0)
        monkeypatch.setattr(moments, "EXPRESSION_PAIRS", 0)
    model = fit_gaussian(points, ["a", "b"], "y", multivariate)
    rows = model.transform(points).toPandas().sort_values("id", ignore_index=True)
    expected = brute(rows, ["a", "b"], multivariate)
    assert (rows["y_prediction"] == expected.idxmax(axis=1)).all()
    assert np.allclose(rows["probability"], np.exp(expected.max(axis=1)))
    each = model.class_probabilities(points).toPandas()
    assert len(each) == 2 * len(rows)
    wide = each.pivot(index="id", columns="y_class", values="probability")
    assert np.allclose(wide.to_numpy(), np.exp(expected.to_numpy()))


@pytest.mark.parametrize("in_batches", [False, True])
def test_missing_feature_has_no_prediction(points, spark, in_batches, monkeypatch):
    model = fit_gaussian(points, ["a", "b"], "y")
    if in_batches:
        monkeypatch.setattr(scores, "QUADRATIC_TERMS", 0)
    row = model.transform(spark.createDataFrame([(None, 1.0)], "a double, b double")).first()
    assert row.y_prediction is None and row.probability is None


def test_singular_covariance_gets_a_ridge(spark):
    frame = spark.createDataFrame([(float(i), 2.0 * i, i % 2) for i in range(8)], "a double, b double, y int")
    model = fit_gaussian(frame, ["a", "b"], "y")
    assert all(c.ridge > 0 and np.isfinite(c.const) for c in model.classes)
    assert model.transform(frame).where("y_prediction IS NULL").count() == 0


def test_constant_feature_gets_a_floor(spark):
    frame = spark.createDataFrame([(1.0, 0), (1.0, 0), (3.0, 1), (4.0, 1)], "a double, y int")
    model = fit_gaussian(frame, ["a"], "y", multivariate=False)
    assert model.classes[0].ridge > 0 and model.classes[1].ridge == 0
    assert [r.y_prediction for r in model.transform(frame).collect()] == [0, 0, 1, 1]


def test_one_feature_and_one_class(spark):
    frame = spark.createDataFrame([(1.0, 7), (2.0, 7)], "a double, y int")
    model = fit_gaussian(frame, ["a"], "y")
    assert [r.y_prediction for r in model.transform(frame).collect()] == [7, 7]
    assert model.classes[0].prior == 1.0


def test_priors_sum_to_one(points, spark):
    model = fit_gaussian(points, ["a", "b"], "y")
    assert np.isclose(model.priors(spark).agg(F.sum("prior")).first()[0], 1.0)
    assert model.parameters(spark).count() == 4 and model.covariances(spark).count() == 8


def test_text_feature(spark):
    rows = [(["lo", "hi"][i % 2], float(i % 5), i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "kind string, a double, y int")
    model = fit_gaussian(frame, ["kind", "a"], "y", multivariate=False)
    assert model.transform(frame).where("y <> y_prediction").count() == 0
    assert set(model.transform(frame).columns) == {"kind", "a", "y", "y_prediction", "probability"}


def test_classifier_and_saved_models(points, spark, tmp_path):
    gc = GaussianClassifier(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        gc.score()
    gc.create_model(points, ["a", "b"], "y", "pair").estimate(id_col="id").predict().score()
    assert 0.8 < gc.get_accuracy() <= 1
    assert gc.get_prediction_array().count() == gc.get_target_array().count() == gc.evaluation.count() < 80
    loaded = GaussianClassifier(spark, str(tmp_path)).load_model("pair")
    assert loaded.multivariate and len(loaded.model.classes) == 2
    a = loaded.predict(points).predictions.orderBy("id").toPandas()
    b = gc.model.transform(points).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert "multivariate" in loaded.get_active_model_description()
    gc.clean_up()
    assert gc.evaluation is None and gc.model is not None
    loaded.drop_model("pair")
    assert loaded.get_model_list().count() == 0


@pytest.mark.parametrize("multivariate", [False, True])
def test_no_row_of_a_box_leaves_the_bounds_of_its_scores(multivariate):
    from statloom.plans import gaussian_table

    draw = np.random.default_rng(4)
    mean, roots = draw.normal(size=(300, 3)), draw.normal(size=(300, 3, 3)) * draw.choice([1, 300], (300, 1, 1))
    precision = roots @ roots.transpose(0, 2, 1) if multivariate else np.eye(3) * draw.exponential(size=(300, 1, 3)) * 1e4
    const = draw.normal(size=300)
    x = draw.normal(size=(40, 1, 3)) + draw.uniform(0, 0.05, size=(40, 25, 3))
    gap = x[:, :, None] - mean
    scores = const - 0.5 * np.einsum("nrci,cij,nrcj->nrc", gap, precision, gap)
    worst, best = gaussian_table.score_bounds(x.min(axis=1), x.max(axis=1), mean, precision, const)
    assert (worst <= scores.min(axis=1)).all() and (best >= scores.max(axis=1)).all()
    left = best >= worst.max(axis=1)[:, None]
    assert left[np.arange(40)[:, None], scores.argmax(axis=2)].all()
    # Few classes are compared with the rows of a box, so few are moved to them.
    assert left.mean() < 0.3


def test_many_classes_by_cells(spark, monkeypatch):
    from statloom.plans import gaussian_table

    monkeypatch.setattr(gaussian_table, "ROW_BLOCK", 50)
    monkeypatch.setattr(gaussian_table, "CLASS_NUMBERS", 40)
    monkeypatch.setattr(gaussian_table, "BOXES", 5)
    monkeypatch.setattr(gaussian_table, "PAIRS_PER_TASK", 2)
    draw = np.random.default_rng(2)
    a, b, y = draw.normal(size=600).round(1), draw.uniform(size=600), draw.integers(0, 60, 600)
    a[:150], b[:150] = a[0], b[0]
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": a, "b": b, "y": y}))
    found = {r["id"]: r for r in gaussian_table.fit_gaussian_table(df, ["a", "b"], "y", False).transform(df).collect()}
    labels, n = np.unique(y, return_counts=True)
    x = np.stack([a, b], axis=1)
    mean, var = (np.array([f(x[y == c], axis=0) for c in labels]) for f in (np.mean, np.var))
    var = np.maximum(var, 1e-9 * var.max(axis=0))
    scores = np.log(n / 600) - 0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean) ** 2 / var).sum(axis=2)
    assert len(found) == 600
    for i in range(600):
        assert np.log(found[i]["probability"]) == pytest.approx(scores[i].max()) and scores[i][labels == found[i]["y_prediction"]][0] == pytest.approx(scores[i].max())
