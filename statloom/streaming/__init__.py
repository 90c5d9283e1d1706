"""Scoring a stream: fitted models are stateless projections, so they apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream's rows with their predictions to parquet files.

    `model` is any fitted model whose `transform` is a projection (regression,
    Gaussian, tree, k-means).
    """
    writer = model.transform(stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
