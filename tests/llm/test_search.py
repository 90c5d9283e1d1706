"""Both searches against all distances and products."""

import math
import random

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from statloom.llm import queries as Q
from statloom.llm import vafile, vectors, vptree

FOLDER = "/root/testdata/sf0.001"


def odd_rows():
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300 + i, [float(draw.randint(-1, 1)) for _ in range(6)]) for i in range(60)]
    rows += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [math.nan] * 6), (404, [math.inf] * 6), (405, [0.0] * 6)]
    return [*rows, (410, [1.0, 2.0]), (420, [2.0, 1.0]), (None, [1.0] * 6), (110, rows[3][1])]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, k, score, better):
    good = [(i, v) for i, v in rows if i is not None and fine(v)]
    queries = {}
    for i, v in good:
        if i % 10 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        all_ = sorted(((better * score(v, w), i) for i, w in good if i != q and len(w) == len(v)))[:k]
        out += [(q, r, i, better * s) for r, (s, i) in enumerate(all_, 1)]
    return sorted(out)


def product(v, w):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))


@pytest.mark.parametrize("shard", [8192, 40])
def test_largest(spark, shard):
    df = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    out = vafile.largest(df, df.where("vec_id % 10 = 0"), k=5, shard=shard).collect()
    assert sorted(map(tuple, out)) == plain(odd_rows(), 5, product, -1)


def test_largest_beyond_doubles(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 3.0]), (2, [1e15, -1.0]), (3, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["vec_id"], r["score"]) for r in vafile.largest(df, df.where("vec_id = 0"), k=3, scale=1.0).orderBy("rank").collect()]
    assert out == [(1, vafile.LARGEST), (2, vafile.LARGEST), (3, vafile.LARGEST)]
    rows = [(0, [1e9, 1.0]), (1, [1e9, 3.0]), (2, [1e9, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["vec_id"], r["score"]) for r in vafile.largest(df, df.where("vec_id = 0"), k=3, scale=1.0).orderBy("rank").collect()]
    assert out == [(2, 10**18 + 4), (1, 10**18 + 3)]


def test_exact_reads_little():
    draw = np.random.default_rng(1)
    vectors, queries = np.floor(draw.normal(0, 40, (3000, 64))), np.floor(draw.normal(0, 40, (20, 64)))
    bounds = vafile.Approximations(vectors).bounds(queries)
    assert (bounds >= queries @ vectors.T).all()
    for i, places, scores in vafile._certain(queries, vectors, 6):
        assert sorted(scores)[-6:] == sorted((queries[i] @ vectors.T).tolist())[-6:] and len(places) < 100


def test_nearest_of_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 4)
    rows = [(i, v) for i, v in odd_rows()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (8192, 40):
        out = vptree.nearest(df, df.where("vec_id % 10 = 0"), k=4, factor=1.0, shard=shard).collect()
        expected = plain([r for r in rows if r[1] and any(r[1])], 4, math.dist, 1)
        found = sorted(map(tuple, out))
        assert [x[:3] for x in found] == [x[:3] for x in expected]
        assert [x[3] for x in found] == pytest.approx([x[3] for x in expected])


@pytest.mark.parametrize("kind", [2, 4, 8, 16, "clusters", "no structure"])
def test_recall_of_full_shards(kind):
    draw = np.random.default_rng(7)
    if kind == "clusters":
        vectors = draw.normal(size=(100, 64))[draw.integers(0, 100, 8192)] + 0.3 * draw.normal(size=(8192, 64))
    else:
        inner = 64 if kind == "no structure" else kind
        vectors = draw.normal(size=(8192, inner)) @ (np.eye(64) if inner == 64 else draw.normal(size=(inner, 64)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.arange(0, 8192, 100)
    walk = vptree.Walk(vectors[asked], asked, [np.array([i]) for i in range(8192)], vectors, 10, vptree.FACTOR)
    walk.visit(vptree.build(vectors, draw.permutation(8192)), np.arange(len(asked)))
    hits = 0
    for i, q in enumerate(asked):
        best = np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1), kind="stable")[1:11]
        hits += len(set(best) & set([p for p in walk.place[i] if p != q][:10]))
    assert hits / (10 * len(asked)) >= 0.95


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(df, df).count() == 0 and vafile.largest(df, df).count() == 0
    with pytest.raises(ValueError):
        vptree.nearest(df, df, factor=0.5)


def test_query_op4(spark):
    found = Q.op4_exact_top_k(spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(Q.ORACLES["op4_exact_top_k"]).df()) is None


def test_recall_of_query_op10(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and fine(v) and any(v)]
    found = {}
    for r in Q.op10_vantage_points(spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, v in ((q, v) for q, v in rows if q % 100 == 0):
        best = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:10]
        hits += len({i for _, i in best} & {i for i, _ in found[q]})
        total += len(best)
        assert len(found[q]) == 10 and found[q] == sorted(found[q], key=lambda x: (x[1], x[0]))
    assert hits / total >= 0.9


@pytest.mark.parametrize("numbers, shards", [(1 << 23, 64), (1 << 23, 2), (24, 64), (24, 1)])
def test_parts_of_any_size(spark, monkeypatch, numbers, shards):
    monkeypatch.setattr(vectors, "HELD_NUMBERS", numbers)
    monkeypatch.setattr(vectors, "PART_SHARDS", shards)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        df = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>")
        found = vafile.largest(df, df.where("vec_id % 10 = 0"), k=5, shard=20)
        assert sorted(map(tuple, found.collect())) == plain(odd_rows(), 5, product, -1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_row_holds_a_shard(spark, capsys):
    """Neither a shard nor a group of queries is one row, of which a batch would hold thousands."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    for found in (vafile.largest(df, df.where("vec_id % 50 = 0"), shard=20), vptree.nearest(df, df.where("vec_id % 100 = 0"), shard=20)):
        found.explain()
        assert "collect_list" not in capsys.readouterr().out
