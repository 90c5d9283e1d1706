"""Quality measures, each one aggregate over rows that hold target and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import number, quoted


def r2(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """1 - sum((y - p)^2) / sum((y - mean(y))^2) over rows that have both."""
    y, p = number(target), number(prediction)
    both = df.select(y.alias("y"), p.alias("p")).dropna()
    residual = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    spread = F.var_pop("y") * F.count("*")
    return both.agg((1 - F.try_divide(residual, F.nullif(spread, F.lit(0.0)))).alias("r2"))


def accuracy(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """cases, tp and accuracy of a prediction; a missing prediction is a miss."""
    hit = F.when(F.col(quoted(target)) == F.col(quoted(prediction)), 1).otherwise(0)
    return df.agg(
        F.count("*").alias("cases"), F.coalesce(F.sum(hit), F.lit(0)).alias("tp"), F.avg(hit).alias("accuracy")
    )


def mutual_information(counts: DataFrame) -> DataFrame:
    """I(X;Y) in bits per feature from (f, x, y, n) counts.

    Written over sums of n*log2(n), which add up in partial aggregates, so no
    feature's values ever meet in one window.
    """
    from statloom.functions.scores import xlog2x

    cube = counts.groupingSets([["f", "x", "y"], ["f", "x"], ["f", "y"]], "f", "x", "y").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g")
    )
    part = {"xy": 0, "x": 1, "y": 2}
    sums = cube.groupBy("f").agg(
        F.sum(F.when(F.col("g") == 0, F.col("n"))).alias("n"),
        *[F.expr(f"sum(IF(g = {g}, {xlog2x('CAST(n AS DOUBLE)')}, NULL)) AS h_{k}") for k, g in part.items()],
    )
    mi = (F.col("h_xy") - F.col("h_x") - F.col("h_y")) / F.col("n") + F.log2("n")
    return sums.select("f", mi.alias("mi"))
