"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from statloom import KMeans, fit_gaussian, fit_histogram, fit_linear, grow_tree
from statloom.operators.quantile import long_form

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


@pytest.fixture(scope="module")
def scored(spark, lines):
    x = ["l_quantity", "l_tax"]
    return {
        "linear": fit_linear(lines, x, "l_extendedprice").transform(lines).select("y_prediction"),
        "gaussian": fit_gaussian(lines, x, "l_returnflag").transform(lines).select("y_prediction"),
        "tree": grow_tree(lines, "l_returnflag", x, [], max_depth=2).transform(lines).select("prediction"),
        "kmeans": KMeans(spark).create_model(lines, x, 3, "m").transform(lines).select("j"),
        "histogram": fit_histogram(lines, "l_returnflag", [], x, 5).predict(lines).select("prediction"),
    }


@pytest.mark.parametrize("name", ["linear", "gaussian", "tree", "kmeans", "histogram"])
def test_scoring_moves_no_rows_and_reads_its_columns_only(scored, name):
    text = plan(scored[name])
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<l_quantity:double,l_tax:double>"
    before_lookup = text.split("BroadcastExchange")[0]
    assert "Exchange hash" not in before_lookup and "Python" not in text


def test_unpivot_feeds_a_partial_aggregate(lines):
    text = plan(long_form(lines, ["l_quantity"]).groupBy("f", "x").agg(F.count("*")))
    assert text.index("Exchange hashpartitioning") < text.index("partial_count")
