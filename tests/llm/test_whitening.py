"""Whitening against the eigenpairs of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import queries as Q
from statloom.llm import whitening

FOLDER = "/root/testdata/sf0.001"
LONG = "vec_id long, embedding array<double>"


def plain(vectors, k, scale=64, shift=1_000_000):
    """Eigenvalues, components, exact sums and the distinct whole-number rows."""
    x = np.array([[math.floor(scale * c) + shift for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, q = np.linalg.eigh(y.T @ y / len(fit))
    return x, fit, values[::-1][:k], q[:, ::-1][:, :k]


def check(vectors, rows, model, k):
    x, fit, values, q = plain(vectors, k)
    n, sums = len(fit), fit.sum(axis=0)
    assert model.n == n and model.sums == sums.tolist()
    np.testing.assert_allclose(model.values, values, rtol=1e-9)
    expected = (x - fit.mean(axis=0)) @ q / np.sqrt(values)
    found = np.array([r["whitened"] for r in rows])
    assert np.abs(found * np.sign((found * expected).sum(axis=0)) - expected).max() < 1e-6
    assert [r["deviation"] for r in rows] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    assert model.identity_error < 1e-9
    assert math.isclose(model.trace, np.trace(np.cov(fit.T, bias=True)), rel_tol=1e-12)


@pytest.mark.parametrize("d,k,spread", [(6, 16, 1.0), (40, 4, 1.0), (60, 5, 0.0)])
def test_matches_the_whole_covariance(spark, d, k, spread):
    draw = np.random.default_rng(d)
    vectors = (draw.normal(size=(400, d)) * np.exp(spread * draw.normal(size=d)) + draw.normal(size=d)).tolist()
    vectors += [vectors[3]] * 150
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], LONG).withColumn("x", F.lit(1))
    rows, model = whitening.whiten(df, components=k)
    out = rows.orderBy("vec_id").collect()
    assert rows.columns == ["vec_id", "embedding", "x", "whitened", "deviation"]
    check(vectors, out, model, min(k, d))


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    good = draw.normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [math.nan] * 3, [math.inf] * 3, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*good, *bad])] + [(None, good[0])], LONG)
    rows, model = whitening.whiten(df)
    out = rows.orderBy(F.asc_nulls_last("vec_id")).collect()
    check([*good, good[0]], out, model, 3)
    with pytest.raises(ValueError):
        model.transform(df.withColumn("Whitened", F.lit(1)))


def test_tables_without_spread(spark):
    for values in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        rows, model = whitening.whiten(spark.createDataFrame([(1, v) for v in values], LONG))
        out = rows.collect()
        assert len(out) == len([v for v in values if v]) and all(r["whitened"] == [] and r["deviation"] == 0 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], LONG)
    rows, model = whitening.whiten(line)
    assert len(model.values) == 1 and all(len(r["whitened"]) == 1 for r in rows.collect())


def test_large_entries_stay_exact(spark):
    values = [[1e300, 0.0], [2.0**50, 1.0], [-3.0, 2.0], [5.0, 2.0]]
    rows, model = whitening.whiten(spark.createDataFrame(list(enumerate(values)), LONG))
    x = [[math.floor(max(min(64 * c, whitening.BOUND), -whitening.BOUND)) + 1_000_000 for c in v] for v in values]
    assert model.sums == [sum(v) for v in zip(*x)]
    assert whitening.deviations(np.array(x), 4, model.sums)[:1] == [None]
    assert rows.count() == 4


def test_iteration_on_close_and_repeated_eigenvalues():
    draw = np.random.default_rng(4)
    for values in (np.linspace(100, 98, 200), np.r_[[5.0] * 10, [4.0] * 190], np.r_[[1e6, 1e3], np.ones(198) * 1e-3], np.zeros(200)):
        q, _ = np.linalg.qr(draw.normal(size=(200, 200)))
        matrix = (q * values) @ q.T
        found, vectors = whitening.largest_pairs(lambda x, m=matrix: m @ x, 200, 6)
        np.testing.assert_allclose(found, values[:6], rtol=1e-9, atol=1e-9)
        assert np.linalg.norm(matrix @ vectors - vectors * found) <= 1e-9 * max(1.0, values[0])


def test_iteration_beside_far_larger_eigenvalues():
    draw = np.random.default_rng(5)
    for values in (np.r_[1e4, np.linspace(100, 98, 199)], np.r_[1e9, 1e9, 1e2, np.linspace(76, 53, 197)], np.r_[1e8, 3e6, 2e4, 100, 90, np.linspace(3, 2, 195)]):
        q, _ = np.linalg.qr(draw.normal(size=(200, 200)))
        matrix = (q * values) @ q.T
        found, vectors = whitening.largest_pairs(lambda x, m=matrix: m @ x, 200, 6)
        np.testing.assert_allclose(found, values[:6], atol=1e-13 * values[0])
        assert np.linalg.norm(matrix @ vectors - vectors * found) <= 1e-13 * values[0]


def test_a_missed_component_is_found():
    values = np.r_[50.0, np.linspace(40, 1, 99)]
    matrix = np.diag(values)
    block = np.eye(100)[:, 1:25]
    fresh, exceeds = whitening._probe(lambda x: matrix @ x, block, values[1:25], 8, np.random.default_rng(1), 0.5)
    assert exceeds and abs(fresh[0, 0]) > 0.99
    assert not whitening._probe(lambda x: matrix @ x, np.eye(100)[:, :24], values[:24], 8, np.random.default_rng(1))[1]


def test_query_op11(spark):
    found = Q.op11_whitening(spark, FOLDER).toPandas()
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, fit, values, q = plain(rows["embedding"].tolist(), 16)
    assert len(found) == 16 * len(rows) and set(found["n"]) == {len(fit)}
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    expected = (x - fit.mean(axis=0)) @ q / np.sqrt(values)
    assert np.abs(wide * np.sign((wide * expected).sum(axis=0)) - expected).max() < 1e-8
    share = found.groupby("component")["explained"].first().to_numpy()
    np.testing.assert_allclose(share, values / np.trace(np.cov(fit.T, bias=True)), rtol=1e-9)
    assert found["identity_error"].max() < 1e-9
