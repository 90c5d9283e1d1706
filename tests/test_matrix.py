import numpy as np
import pandas as pd
import pytest

from statloom.operators import matrix
from statloom.operators.matrix import (
    cross_products,
    get_column_names,
    get_number_of_rows,
    multiply_coordinates,
    multiply_matrices,
    to_coordinates,
    to_wide,
    transpose,
    transpose_coordinates,
)


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame([(2, 4.0, 5.0, 6.0), (1, 1.0, 2.0, 3.0)], "id int, x1 double, x2 double, x3 double")


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame([(3, 5.0, 6.0), (1, 1.0, 2.0), (2, 3.0, 4.0)], "id int, x1 double, x2 double")


def values(frame):
    return frame.orderBy("id").toPandas().drop(columns="id").to_numpy()


@pytest.mark.parametrize("terms", [300, 0])
def test_product(a, b, terms, monkeypatch):
    monkeypatch.setattr(matrix, "EXPRESSION_TERMS", terms)
    assert multiply_matrices(a, b).columns == ["id", "x1", "x2"]
    assert np.array_equal(values(multiply_matrices(a, b)), [[22, 28], [49, 64]])


def test_dimensions_must_fit(a, spark):
    bad = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, x1 double")
    with pytest.raises(ValueError, match="dimension"):
        multiply_matrices(a, bad)


def test_transpose_and_coordinates(a):
    assert np.array_equal(values(transpose(a)), values(a).T)
    assert np.array_equal(values(transpose(transpose(a))), values(a))
    cells = to_coordinates(a)
    assert cells.count() == 6
    assert np.array_equal(values(to_wide(transpose_coordinates(cells), [1, 2])), values(a).T)


def test_sparse_product_with_copies(spark, monkeypatch):
    generator = np.random.default_rng(4)
    left = pd.DataFrame({"i": generator.integers(0, 9, 200), "k": np.where(generator.random(200) < 0.4, 1, generator.integers(0, 7, 200)), "v": generator.random(200)})
    right = pd.DataFrame({"k": generator.integers(0, 7, 90), "j": generator.integers(0, 5, 90), "v": generator.random(90)})
    dense = left.pivot_table(index="i", columns="k", values="v", aggfunc="sum", fill_value=0).reindex(columns=range(7), fill_value=0)
    other = right.pivot_table(index="k", columns="j", values="v", aggfunc="sum", fill_value=0).reindex(index=range(7), fill_value=0)
    expected = dense.to_numpy() @ other.to_numpy()
    for limit in (1000, 1):
        monkeypatch.setattr(matrix, "BROADCAST_ROWS", limit)
        found = multiply_coordinates(spark.createDataFrame(left), spark.createDataFrame(right)).toPandas()
        assert np.allclose(found.pivot(index="i", columns="j", values="v").fillna(0).to_numpy(), expected)


def test_cross_products_and_facts(a, spark):
    found = cross_products(a, ["x1", "x2", "x3"]).toPandas().pivot(index="i", columns="j", values="v").to_numpy()
    assert np.allclose(found, values(a).T @ values(a))
    a.createOrReplaceTempView("matrix_a")
    assert get_column_names(spark, "matrix_a") == ["id", "x1", "x2", "x3"]
    assert get_number_of_rows(spark, a) == 2
