"""Published tables against plain dictionaries, and writers that meet."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from statloom.sources.published import PublishedTable
from statloom.sources.registry import ModelRegistry

KIND = "k int, a string, b double"


def held(table):
    return {r.k: (r.a, r.b) for r in table.read().collect()}


def test_updates_match_a_dictionary(spark, tmp_path):
    draw = random.Random(4)
    plain = {i: (f"v{i}", float(i)) for i in range(60)} | {None: ("none", 0.5)}
    table = PublishedTable(spark, str(tmp_path)).write(spark.createDataFrame([(k, *v) for k, v in plain.items()], KIND), ["k"], buckets=5)
    assert held(table) == plain
    for _ in range(3):
        keys = [*draw.sample(range(80), 12), None]
        table.update(spark.createDataFrame([(k, k and k * 10.0) for k in keys], "k int, b double"))
        for k in keys:
            plain[k] = (plain.get(k, (None,))[0], k and k * 10.0)
        gone = [draw.randrange(80) for _ in range(9)] * 2
        table.remove(spark.createDataFrame([(k,) for k in gone], "k int"))
        plain = {k: v for k, v in plain.items() if k not in gone}
        assert held(table) == plain
    with pytest.raises(ValueError):
        table.update(spark.createDataFrame([(1, 2)], "k int, other int"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path)).write(spark.range(400).selectExpr("CAST(id AS INT) AS k", "'x' AS a", "1D AS b"), ["k"], buckets=8)
    before = table._latest()["places"]
    table.update(spark.createDataFrame([(7, "y", 2.0)], KIND))
    after = table._latest()["places"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    table.remove(spark.range(400).selectExpr("CAST(id AS INT) AS k"))
    assert held(table) == {} and table.read().columns == ["k", "a", "b"]


def test_empty_and_missing_tables(spark, tmp_path):
    empty = spark.createDataFrame([], KIND)
    table = PublishedTable(spark, str(tmp_path / "a")).write(empty, ["k"])
    assert held(table) == {}
    assert held(table.update(empty)) == {} and held(table.update(spark.createDataFrame([(1, "a", 1.0)], KIND))) == {1: ("a", 1.0)}
    with pytest.raises(KeyError):
        PublishedTable(spark, str(tmp_path / "b")).read()
    with pytest.raises(ValueError):
        table.write(spark.createDataFrame([(1, 1)], "k int, bucket_of_row int"), ["k"])


def test_writers_get_ids_of_their_own(spark, tmp_path):
    def claim(name):
        return ModelRegistry(spark, str(tmp_path), "kind").new_id(name)

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(claim, ["a", "b", "c", "d"]))
    assert len(set(ids)) == 4
    with pytest.raises(ValueError):
        claim("a")


def test_replaced_and_dropped_models(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path), "kind")
    assert registry.entries() == [] and registry.new_id(None) == "m0"
    first = registry.new_id("one")
    registry.save(first, {"name": "one", "state": 1}, spark.range(3))
    registry.save(first, {"name": "one", "state": 2}, registry.params(first).union(spark.range(1)))
    assert registry.params("m1").count() == 4 and [m["state"] for m in registry.entries()] == [2]
    registry.drop("one")
    assert registry.entries() == [] and registry.new_id("one") == "m1"
    with pytest.raises(KeyError):
        registry.params("m1")
