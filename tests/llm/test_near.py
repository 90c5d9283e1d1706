"""Near-duplicate classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.llm import near as N
from statloom.llm.common import Scratch
from statloom.llm.queries import op5_minhash_near_dedup
from statloom.llm.shingles import lowered, shingles

FOLDER = "/root/testdata/sf0.001"


def plain_set(text, width=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return Counter()
    width = min(width, len(words))
    return Counter(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def plain_classes(texts, threshold=0.8):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            small, large = sorted((sum(x.values()), sum(sets[j].values())))
            if small and small >= 0.3 * large and x.keys() & sets[j].keys() and plain_similarity(x, sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def texts():
    draw = random.Random(4)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "naïve"]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 8, 60, 200]))] for _ in range(25)]
    made = []
    for base in bases:
        for _ in range(draw.randint(1, 6)):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 5])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            made.append((" ".join(words) + draw.choice([".", "", "!"])).capitalize())
    return [None, "", " ... ", "one", "One!", "a a a a a a a a", "a a a a a a a a a", *made, *made[:4]]


def test_shingles_are_the_words():
    rows = texts()
    data, starts = lowered(pa.array(rows))
    row, digest, weight = shingles(data, starts, 5)
    known = {}
    for i, text in enumerate(rows):
        expected = plain_set(text)
        mine = dict(zip(digest[row == i].tolist(), weight[row == i].tolist()))
        assert sorted(mine.values()) == sorted(expected.values())
        known.setdefault(frozenset(mine.items()), set()).add(frozenset(expected.items()))
    assert all(len(v) == 1 for v in known.values())


def test_registers_estimate_the_similarity():
    draw = random.Random(8)
    x = {i: draw.choice([1, 1, 1, 4]) for i in range(80)}
    y = {i: draw.choice([1, 1, 2]) for i in range(20, 100)}
    shared = 0
    for trial in range(40):
        rows, hashes, weights = [], [], []
        for row, s in enumerate((x, y)):
            for k, w in s.items():
                rows.append(row)
                hashes.append(N.mixed(np.array([k * 1000 + trial + 1], np.uint64))[0])
                weights.append(w)
        reg = N.registers(np.array(rows), np.array(hashes, np.uint64), np.array(weights), 2)
        shared += ((reg[0] ^ reg[1]) & np.uint64(0xFFFFFFFF) == 0).mean() / 40
    assert shared == pytest.approx(plain_similarity(x, y), abs=0.03)


def test_similarity_is_exact():
    draw = random.Random(6)
    for _ in range(50):
        x, y = ({k: draw.randint(1, 4) for k in draw.sample(range(30), draw.randint(1, 20))} for _ in range(2))
        sides = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in (x, y)]
        assert N.similarity(*sides[0], *sides[1]) == pytest.approx(plain_similarity(x, y))
        ones = [Counter(s.keys()) for s in (x, y)]
        assert N.similarity(sides[0][0], None, sides[1][0], None) == pytest.approx(plain_similarity(*ones))


@pytest.mark.parametrize("block", [128, 3])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("class", F.lit("x"))
    found = {r["doc_id"]: r for r in N.near_classes(df).collect()}
    assert [found[i]["class_id"] for i in range(len(rows))] == plain_classes(rows)
    assert {i for i, r in found.items() if r["stays"]} == set(plain_classes(rows))
    kept = N.drop_near(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(plain_classes(rows))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted((str(r["class_id"]), r["stays"]) for r in N.near_classes(df).collect()) == [("1", False), ("1", True), ("1", True), ("None", True), ("None", True)]
    assert N.drop_near(df).count() == 3
    assert N.near_classes(df.limit(0)).count() == 0 and N.drop_near(df.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    label = {n: n for pair in links for n in pair}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert all(found.get(n, n) == v for n, v in label.items())


def test_query(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected = plain_classes([d["text"] for d in documents])
    found = {r["doc_id"]: r["class_id"] for r in op5_minhash_near_dedup(spark, FOLDER).collect()}
    least = {}
    for d, c in zip(documents, expected):
        least[c] = min(least.get(c, d["doc_id"]), d["doc_id"])
    assert found == {d["doc_id"]: least[c] for d, c in zip(documents, expected)}
