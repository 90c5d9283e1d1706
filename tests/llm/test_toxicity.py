"""Held-out accuracy, and the cases that have no model."""

import zlib

import pytest
from pyspark.sql import functions as F

from statloom.llm import toxicity as X
from statloom.llm.queries import op6_toxicity

FOLDER = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    lexicon, beginnings = {"rude": 1.0}, {"nast": 2.0}
    for text in ["", "   ", "a", "!" * 10_000, "rude " * 10_000, "é😀\0"]:
        found = X.text_features(text, lexicon, beginnings, frozenset(["nast"]))
        assert len(found) == len(X.FEATURES) and all(abs(x) < 1e9 for x in found)
    found = dict(zip(X.FEATURES, X.text_features("You NASTIER rude thing!", lexicon, beginnings, frozenset(["nast"]))))
    assert found["lexicon_density"] == found["beginning_density"] == 0.25 and found["nearness"] > 1 and found["shouted"] == 0.25


def test_query_on_held_out_rows(spark):
    out = op6_toxicity(spark, FOLDER).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
    toxic, clean = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.75


def test_without_both_classes(spark):
    documents = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string").withColumn("_raw", F.lit(0))
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in X.fit(documents, labels).transform(documents).collect()] == [0.0] * 3
    assert X.fit(documents.limit(0), labels.limit(0)).transform(documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.fit(documents, labels).transform(documents, score="_RAW")
