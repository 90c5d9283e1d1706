import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import KMeans
from statloom.functions import scores
from statloom.operators import silhouette
from statloom.operators.silhouette import euclidean_silhouette, squared_silhouette
from statloom.plans.kmeans import normalise, start_rows


@pytest.fixture(scope="module")
def points(spark):
    generator = np.random.default_rng(2)
    rows = np.round(np.vstack([generator.normal(m, 1, (30, 2)) for m in (0, 6, 12)]), 1)
    rows = np.vstack([rows, np.repeat(rows[:1], 40, axis=0)])
    return spark.createDataFrame(pd.DataFrame(rows, columns=["a", "b"]).assign(id=range(len(rows))))


def lloyd(x, centres, steps):
    for _ in range(steps):
        dist = ((x[:, None] - centres) ** 2).sum(axis=2)
        j = dist.argmin(axis=1)
        variance = dist.min(axis=1).sum() / len(x)
        centres = np.array([x[j == c].mean(axis=0) if (j == c).any() else centres[c] for c in range(len(centres))])
    return centres, variance, j


@pytest.mark.parametrize("in_batches", [False, True])
def test_steps_match_brute_force(points, spark, in_batches, monkeypatch):
    if in_batches:
        monkeypatch.setattr(scores, "EXPRESSION_TERMS", 0)
    x = points.orderBy("id").toPandas()[["a", "b"]].to_numpy()
    model = KMeans(spark).create_model(points, ["a", "b"], 3, "m", start=x[:3].tolist()).estimate(2)
    centres, variance, j = lloyd(x, x[:3], 2)
    assert np.allclose(model.centroids, centres) and np.isclose(model.variance, variance)
    assert (model.assignments().orderBy("id").toPandas()["j"] == j).all()
    model.estimate(2)
    centres, variance, _ = lloyd(x, x[:3], 4)
    assert np.allclose(model.centroids, centres) and model.get_information()["steps"] == 4
    assert model.estimate(200).get_information()["steps"] < 60


def test_empty_cluster_keeps_its_centre(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "a double")
    model = KMeans(spark).create_model(frame, ["a"], 3, "m", start=[[0.0], [10.0], [900.0]]).estimate(5)
    assert np.allclose(model.centroids.ravel(), [0.5, 10.0, 900.0])


@pytest.mark.parametrize("in_batches", [False, True])
def test_incomplete_rows_get_no_cluster(spark, in_batches, monkeypatch):
    if in_batches:
        monkeypatch.setattr(scores, "EXPRESSION_TERMS", 0)
    frame = spark.createDataFrame([(0.0, 1.0), (4.0, 1.0), (None, 1.0), (1.0, float("nan"))], "a double, b double")
    model = KMeans(spark).create_model(frame, ["a", "b"], 2, "m", start=[[0.0, 1.0], [4.0, 1.0]]).estimate(3)
    assert [r.j for r in model.assignments().collect()] == [0, 1, None, None]
    assert model.cluster_sample().count() == 2 and model.get_information()["n"] == 4
    assert model.get_silhouette_avg() is None


def test_constant_feature_has_no_scale(spark):
    frame = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "a double, b double")
    rows = normalise(frame, ["a", "b"], "z-score").collect()
    assert [r.x_0 for r in rows] == [None, None] and [r.x_1 for r in rows] == [-1.0, 1.0]
    with pytest.raises(ValueError):
        normalise(frame, ["a"], "unknown")


def test_start_rows_are_different_and_seeded(points, spark):
    chosen = start_rows(points.select("a", "b"), 5, 1)
    assert len({tuple(c) for c in chosen}) == 5
    assert (chosen == start_rows(points.select("a", "b").repartition(5), 5, 1)).all()
    few = spark.createDataFrame([(1.0,)] * 50 + [(2.0,), (3.0,)], "a double")
    assert sorted(start_rows(few, 3, 1).ravel()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError, match="different"):
        start_rows(few, 4, 1)


def brute_silhouette(x, j, squared=False):
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    dist = dist**2 if squared else dist
    found = []
    for i in range(len(x)):
        own = (j == j[i]).sum()
        if own == 1:
            continue
        a = dist[i, j == j[i]].sum() / (own - 1)
        b = min(dist[i, j == c].mean() for c in set(j) - {j[i]})
        if max(a, b) > 0:
            found.append((b - a) / max(a, b))
    return np.mean(found)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_silhouettes_match_brute_force(points, spark, block_rows, monkeypatch):
    rows = points.toPandas()[["a", "b"]]
    rows["j"] = np.where(rows["a"] > 9, 5, np.where(rows["a"] > 3, 2, 9))
    rows.loc[len(rows)] = [99.0, 99.0, 77]
    frame = spark.createDataFrame(rows.astype({"j": "int32"}))
    x, j = rows[["a", "b"]].to_numpy(), rows["j"].to_numpy()
    assert np.isclose(euclidean_silhouette(frame, ["a", "b"], "j", block_rows), brute_silhouette(x, j))
    assert np.isclose(squared_silhouette(frame, ["a", "b"], "j"), brute_silhouette(x, j, squared=True))
    monkeypatch.setattr(scores, "EXPRESSION_TERMS", 0)
    assert np.isclose(squared_silhouette(frame, ["a", "b"], "j"), brute_silhouette(x, j, squared=True))


@pytest.mark.parametrize("d", [1, 2])
def test_silhouette_by_cells_matches_brute_force(spark, d):
    draw = np.random.default_rng(d)
    # Uneven: a dense spot, lines, a far point and a cluster of one, with copies.
    x = np.concatenate([draw.normal(0, 1e-3, (500, 2)), np.c_[draw.uniform(-3, 3, 2000), draw.integers(0, 5, 2000)], [[40.0, -7.0]]])
    x = np.concatenate([x, x[:100]])[:, :d]
    j = (np.abs(x[:, 0]) > 1).astype(int) + (x[:, 0] > 30)
    frame = spark.createDataFrame([(*map(float, row), int(c)) for row, c in zip(x, j)], ["a", "b"][:d] + ["j"])
    found = euclidean_silhouette(frame, ["a", "b"][:d], "j", far_rows=100)
    assert np.isclose(found, brute_silhouette(x, j), rtol=1e-12, atol=0)


def test_far_cells_lose_no_distance(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.uniform(-1, 1, (60_000, 2))
    j = (x[:, 0] + 0.3 * x[:, 1] > 0.1).astype(int)
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "j": j}))
    pairs = []
    monkeypatch.setattr(silhouette, "_by_cells", lambda *a, by=silhouette._by_cells: pairs.append(a) or by(*a))
    found = euclidean_silhouette(frame, ["a", "b"], "j")
    assert len(pairs) == 1 and np.isclose(found, euclidean_silhouette(frame, ["a", "b"], "j", far_rows=1 << 60), rtol=1e-12, atol=0)


def test_best_k_and_saved_models(points, spark, tmp_path):
    factory = KMeans(spark, str(tmp_path))
    points.createOrReplaceTempView("km_points")
    best = factory.create_ideal_model("km_points", ["a", "b"], [2, 3], "try", "z-score", metric="squared", max_steps=8)
    assert set(factory.silhouettes) == {2, 3}
    assert sorted(factory.get_model_names()) == ["km_points_try_k2", "km_points_try_k3"]
    loaded = factory.load_model(best.name, "km_points")
    assert loaded.get_information() == best.get_information()
    assert np.array_equal(loaded.centroids, best.centroids)
    assert loaded.estimate(1).get_information()["steps"] == best.steps + 1
    with pytest.raises(RuntimeError):
        factory.load_model(best.name).assignments()
    factory.drop_model(best.name)
    assert len(factory.get_model_names()) == 1


def test_cluster_sample_is_limited_per_cluster(points, spark):
    x = points.orderBy("id").select("a", "b").limit(2).collect()
    model = KMeans(spark).create_model(points, ["a", "b"], 2, "m", start=[list(r) for r in x]).estimate(1)
    per_cluster = model.cluster_sample(4).groupBy("j").count().collect()
    assert all(r["count"] <= 4 for r in per_cluster)
    assert model.cluster_sample().count() == points.select("a", "b").distinct().count()


def test_wide_points_stay_cheap_to_plan(spark):
    names = [f"c{i}" for i in range(30)]
    frame = spark.range(300).select(*[F.rand(i).alias(n) for i, n in enumerate(names)])
    model = KMeans(spark).create_model(frame, names, 3, "m", "min-max").estimate(2, cache=False)
    assert model.get_silhouette_avg("squared") is not None
