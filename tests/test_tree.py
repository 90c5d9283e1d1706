import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import DecisionTreeClassifier, TreeModel, grow_tree
from statloom.plans import stored_tree, tree
from statloom.plans.tree import class_labels, numeric_scores, prepare, value_counts


@pytest.fixture(scope="module")
def rows(spark):
    generator = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "id": range(400),
            "a": np.round(generator.normal(0, 1, 400), 1),
            "b": generator.integers(0, 50, 400).astype(float),
            "c": generator.choice(["u", "v's", "w"], 400),
        }
    )
    frame["y"] = np.where(frame["a"] + (frame["c"] == "w") * 2 > 0.6, "B's", "A")
    frame.loc[frame["id"] % 17 == 0, "a"] = np.nan
    frame.loc[frame["id"] % 23 == 0, "c"] = None
    return spark.createDataFrame(frame)


def information(left, whole):
    n = sum(whole.values())
    total = 0.0
    for side in (left, {k: whole[k] - left.get(k, 0) for k in whole}):
        s = sum(side.values())
        for k, v in side.items():
            if v:
                total += v / n * math.log2((v / n) / ((s / n) * (whole[k] / n)))
    return total


def test_scores_match_brute_force(rows):
    labels = class_labels(rows, "y")
    data = prepare(rows, "y", labels, ["a"], []).withColumn("node", F.lit(1))
    found = numeric_scores(value_counts(data, ["a"], 2), 2, "full", False).collect()
    pairs = [(r.a, r.y) for r in rows.select("a", "y").collect() if r.a is not None and not math.isnan(r.a)]
    whole = Counter(y for _, y in pairs)
    assert len(found) == len({x for x, _ in pairs})
    for r in found:
        assert math.isclose(r.mi, information(Counter(y for x, y in pairs if x <= r.x), whole), abs_tol=1e-9)


@pytest.mark.parametrize("criterion", ["full", "partial"])
def test_every_way_to_grow_is_the_same(rows, criterion):
    options = dict(max_depth=3, criterion=criterion)
    whole = grow_tree(rows, "y", ["a", "b"], ["c"], **options)
    for other in (dict(local_rows=0, chunk_rows=40), dict(local_rows=200)) if criterion == "full" else (dict(local_rows=200),):
        grown = grow_tree(rows, "y", ["a", "b"], ["c"], **options, **other)
        assert list(grown.nodes) == list(whole.nodes)
        for n, m in zip(grown.nodes.values(), whole.nodes.values()):
            a, b = dict(vars(n)), dict(vars(m))
            assert a.pop("mi") == pytest.approx(b.pop("mi")) and a == b


def test_features_may_have_any_name(rows):
    names = {"a": "depth", "b": "node", "c": "kind"}
    plain = grow_tree(rows, "y", ["a", "b"], ["c"], max_depth=3, local_rows=200)
    named = grow_tree(rows.withColumnsRenamed({**names, "y": "label"}), "label", ["depth", "node"], ["kind"], max_depth=3, local_rows=200)
    assert [(n.feature and names[n.feature], n.counts, n.threshold, n.level) for n in plain.nodes.values()] == [(n.feature, n.counts, n.threshold, n.level) for n in named.nodes.values()]
    taken = grow_tree(rows.withColumnsRenamed({"a": "_y", "b": "_chunk_0"}), "y", ["_y", "_chunk_0"], ["c"], max_depth=2)
    assert [n.counts for n in taken.nodes.values()] == [n.counts for n in plain.nodes.values() if n.depth <= 2]


def test_noise_is_grown_to_the_end(spark):
    draw = np.random.default_rng(6)
    frame = pd.DataFrame({"a": draw.normal(size=4000), "b": draw.integers(0, 40, 4000), "c": draw.choice(list("uvwxyz"), 4000), "y": draw.integers(0, 3, 4000)})
    rows = spark.createDataFrame(frame)
    stored = stored_tree.grow(rows, "y", ["a", "b"], ["c"])
    assert stored.nodes() > 1000
    assert stored.transform(rows).where("y <> prediction").count() == 0


def test_stored_trees_route_by_joins(rows, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_tree, "WALK_ROWS", 40)
    stored = stored_tree.grow(rows, "y", ["a", "b"], ["c"], max_depth=5, local_rows=250, folder=str(tmp_path / "grown"))
    expected = {r.id: r.prediction for r in stored.transform(rows).collect()}
    odd = rows.withColumnsRenamed({"y": "_node"}).withColumn("_class", F.lit(1)).withColumn("_to", F.lit(2))
    stored.save(str(tmp_path / "saved"))
    again = stored_tree.StoredTree.load(spark, str(tmp_path / "saved"))
    for tree_ in (stored, again):
        found = tree_.routed(odd)
        assert found.columns == [*odd.columns, "prediction"]
        assert {r.id: r.prediction for r in found.collect()} == expected
    assert again.model().case_text() == stored.model().case_text()
    with pytest.raises(ValueError):
        stored_tree.StoredTree.load(spark, str(tmp_path / "saved")).model(limit=2)
    shallow = stored_tree.grow(rows, "y", ["a"], [], max_depth=0)
    assert shallow.routed(rows).select("prediction").distinct().count() == 1


def test_every_way_to_predict_agrees(rows, spark, monkeypatch):
    model = grow_tree(rows, "y", ["a", "b"], ["c"], max_depth=5)
    expected = {r.id: r.prediction for r in model.transform(rows).collect()}
    model.create_function(spark, "predict_rows")
    by_text = rows.select("id", F.expr(model.case_text()).alias("p"), F.expr("predict_rows(a, b, c)").alias("q"))
    found = by_text.collect()
    assert {r.id: r.p for r in found} == {r.id: r.q for r in found} == expected
    monkeypatch.setattr(tree, "EXPRESSION_NODES", 0)
    assert {r.id: r.prediction for r in model.transform(rows).collect()} == expected
    counts = dict(rows.groupBy(model.node_column().alias("n")).count().collect())
    assert counts == {i: n.n for i, n in model.nodes.items() if n.is_leaf}


def test_equal_rows_of_two_classes_end(spark):
    frame = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "a double, y int")
    model = grow_tree(frame, "y", ["a"], [])
    assert len(model.nodes) == 1 and model.predicted(model.nodes[1]) == 1
    partial = grow_tree(frame, "y", ["a"], [], criterion="partial")
    assert len(partial.nodes) == 1


def test_one_class_and_stops(spark):
    frame = spark.createDataFrame([(float(i), "x") for i in range(5)], "a double, y string")
    assert len(grow_tree(frame, "y", ["a"], []).nodes) == 1
    mixed = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "a double, y int")
    assert all(n.n >= 8 for n in grow_tree(mixed, "y", ["a"], [], max_samples=8).nodes.values() if not n.is_leaf)
    assert len(grow_tree(mixed, "y", ["a"], [], max_mutual_inf=0.9).nodes) == 1
    full = grow_tree(mixed, "y", ["a"], [])
    assert full.transform(mixed).where("y <> prediction").count() == 0
    with pytest.raises(ValueError):
        grow_tree(mixed, "y", ["a"], [], criterion="other")


def test_partial_score_of_the_first_split(spark):
    frame = spark.createDataFrame([(1.0, "p"), (1.0, "q"), (2.0, "q"), (3.0, "q")], "a double, y string")
    root = grow_tree(frame, "y", ["a"], [], criterion="partial", max_depth=1).nodes[1]
    # left of 1: one p of one, one q of three, among four rows
    expected = 1 / 4 * math.log2((1 / 4) / (1 / 4 * 2 / 4)) + 1 / 4 * math.log2((1 / 4) / (3 / 4 * 2 / 4))
    assert root.threshold in (1.0, 2.0) and root.mi >= expected - 1e-12


def test_bins_restrict_thresholds(rows):
    model = grow_tree(rows, "y", ["b"], [], max_depth=2, max_bins=4)
    assert {n.threshold for n in model.nodes.values() if n.threshold is not None} <= {r.b for r in rows.select("b").distinct().collect()}


def test_save_and_load(rows, spark, tmp_path):
    model = grow_tree(rows, "y", ["a", "b"], ["c"], max_depth=3)
    model.save(spark, str(tmp_path))
    loaded = TreeModel.load(spark, str(tmp_path))
    assert loaded.case_text() == model.case_text()
    assert loaded.node_table(spark).count() == len(model.nodes)


def test_classifier(rows, spark, tmp_path):
    rows.drop("id").createOrReplaceTempView("tree_rows")
    by_default = DecisionTreeClassifier(spark).initialize("tree_rows")
    assert (by_default.target, by_default.numeric, by_default.categorical) == ("y", ["a", "b"], ["c"])
    assert by_default.target_classes == ["A", "B's"]
    tree_model = DecisionTreeClassifier(spark).initialize(rows, "y", features=["a", "b", "c"])
    tree_model.train_test_split(0.7, 1, encode=True, id_col="id", exact=True)
    assert tree_model.train.count() == 280 and tree_model.categorical == []
    tree_model.estimate(max_samples=10, max_depth=4)
    assert tree_model.score() > 0.7
    text = tree_model.create_model(str(tmp_path / "case"))
    assert text.startswith("CASE") and spark.read.text(str(tmp_path / "case")).count() == len(text.splitlines())
    predicted = tree_model.predict_table(stored_procedure=True)
    assert predicted.count() == 120 and "prediction" in predicted.columns
    tree_model.save_dtc_tree(str(tmp_path / "tree"))
    again = DecisionTreeClassifier(spark).read_dtc_tree(str(tmp_path / "tree"))
    assert again.predict(tree_model.evaluation).where("prediction IS NULL").count() == 0
    assert tree_model.visualize_tree().where("is_leaf").count() > 1


def test_depths_of_routed_rows(rows):
    stored = stored_tree.grow(rows, "y", ["a", "b"], ["c"], max_depth=6, local_rows=40)
    model = stored.model()
    depths = {n.node_id: n.depth for n in model.nodes.values()}
    expected = {r.id: (r.prediction, depths[r.node]) for r in model.transform(rows).withColumn("node", model.node_column()).collect()}
    routed = stored.routed(rows, depth_output="depth").collect()
    assert {r.id: (r.prediction, r.depth) for r in routed} == expected and len(routed) == len(expected)


def test_full_tree_is_not_held_as_one_object(spark, monkeypatch, tmp_path):
    from statloom.catalog import trees

    def refuse(*_, **__):
        raise ValueError("nodes of a tree: more than 500000 rows")

    monkeypatch.setattr(stored_tree.StoredTree, "_collected", refuse)
    part = spark.createDataFrame([(i, f"t{i * 7 % 3}", i % 11, i / 4, f"b{i % 5}") for i in range(90)], "p_partkey long, p_type string, p_size int, p_retailprice double, p_brand string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = trees.full(spark, str(tmp_path)).collect()
    assert sum(r.n for r in found) == 90 and {r.prediction for r in found} == {"t0", "t1", "t2"}
