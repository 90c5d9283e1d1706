"""Mined negatives against all products, and the bounds that leave rows out."""

import math
import random

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from statloom.llm import negatives
from statloom.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
LONG = "vec_id long, label int, embedding array<double>"


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, positives=5, keep=10):
    good = sorted({(i, str(y), tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and fine(v)})
    anchors, out = {}, []
    for i, y, v in good:
        if i % 10 == 0:
            anchors[i] = min((y, v), anchors.get(i, (y, v)))
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            found = [(i, -t) for t, i, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:keep]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(found, 1)]
    return sorted(out)


def odd_rows(kind):
    draw = random.Random(kind)
    middles = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = []
    for i in range(240):
        m = middles[i % 7]
        noise = {"wide": 1.0, "tight": 0.2, "norms": 0.3}[kind]
        long = math.exp(draw.gauss(0, 1)) if kind == "norms" else 1.0
        rows.append((i, draw.choice([0, 1, 1, 1, 2]), [long * (x + draw.gauss(0, noise)) for x in m]))
    rows += [(300 + i, i % 2, rows[10][2]) for i in range(30)] + [(400 + i, i % 3, [float(draw.randint(-1, 1)) for _ in range(6)]) for i in range(60)]
    rows += [(500, 1, None), (510, 1, []), (520, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (530, 1, [math.nan] * 6), (540, 1, [math.inf] * 6), (550, 1, [0.0] * 6)]
    rows += [(560, None, [1.0] * 6), (None, 1, [1.0] * 6), (570, 1, [1.0, 2.0]), (571, 1, [2.0, 2.0]), (572, 2, [1.0, 1.0]), (110, 2, rows[3][2]), rows[20], rows[20]]
    return rows


@pytest.mark.parametrize("kind,shard", [("wide", 8192), ("wide", 40), ("tight", 40), ("norms", 30)])
def test_mined_rows(spark, kind, shard):
    df = spark.createDataFrame(odd_rows(kind), LONG).withColumn("id", F.lit(1)).withColumn("cell", F.lit(1))
    out = negatives.mine(df, df.where("vec_id % 10 = 0"), shard=shard, group=16).collect()
    assert sorted(map(tuple, out)) == plain(odd_rows(kind))


def test_beyond_doubles(spark):
    rows = [(0, 0, [3e6 + 1, 1.0]), (1, 0, [3e6, 0.0]), (2, 0, [3e6, 1.0]), (3, 1, [2e6, 1.0]), (4, 1, [2e6, 3.0])]
    df = spark.createDataFrame(rows, LONG)
    assert sorted(map(tuple, negatives.mine(df, df.where("vec_id = 0")).collect())) == [r for r in plain(rows) if r[0] == 0]
    far = spark.createDataFrame([(0, 0, [1e200, 1.0]), (1, 0, [1e200, 1.0]), (2, 1, [1e-2, 1.0]), (3, 1, [1e200, 0.0])], LONG)
    assert negatives.mine(far, far.where("vec_id = 0")).count() == 0


def test_windows_leave_out_only_what_cannot_count():
    draw = np.random.default_rng(5)
    middles, which = draw.normal(0, 150, (30, 32)), draw.integers(0, 30, 3000)
    vectors = np.floor(middles[which] + draw.normal(0, 30, (3000, 32)))
    references = negatives._directions(middles[:1].tolist(), [32])[32]
    asked, angle = vectors[::100], negatives.angles(vectors[::100], references)[:, 0]
    for cell in (vectors, vectors[which == 0]):
        held = negatives.Shard(np.arange(len(cell)), np.zeros(len(cell)), cell, negatives.angles(cell, references)[:, 0])
        scores = asked @ held.vectors.T
        for share in (0.3, 0.8, 0.95):
            low, high = (np.floor(share * (asked * asked).sum(axis=1) * f) for f in (1.0, 1.1))
            begin, end = held.window(angle, np.linalg.norm(asked, axis=1), low, high)
            for i in range(len(asked)):
                outside = np.r_[scores[i, : begin[i]], scores[i, end[i] :]]
                assert not ((outside >= low[i]) & (outside <= high[i])).any()
    # Rows of a cell are near its reference, so most anchors of other cells meet none of them.
    assert (end == begin).mean() > 0.8


def test_hot_labels_and_copies(spark):
    draw = random.Random(2)
    common = [draw.gauss(0, 1) for _ in range(6)]
    rows = [(i, 1 if i % 3 else draw.randint(2, 4), common if i % 3 == 1 else [draw.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, LONG)
    out = negatives.mine(df, df.where("vec_id % 10 = 0"), shard=50).collect()
    assert sorted(map(tuple, out)) == plain(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], LONG)
    assert negatives.mine(df, df).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], LONG)
    assert negatives.mine(one, one).count() == 0 and negatives.mine(one, df).count() == 0


def test_query_op13(spark):
    found = Q.op13_hard_negatives(spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(Q.ORACLES["op13_hard_negatives"]).df()) is None
