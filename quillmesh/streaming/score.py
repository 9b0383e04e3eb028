"""Scoring a stream with a fitted model, and a forest that grows by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(model, stream: DataFrame) -> DataFrame:
    """The model's predictions over a stream of points(id, v); stateless, any sink."""
    return model.predict(stream)


def windowed_counts(scored: DataFrame, ts: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per window and component, tolerating rows that are late by at most the watermark."""
    return scored.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "k").agg(F.count(F.lit(1)).alias("n"))


class GrowingForest:
    """foreachBatch target: inserts each micro-batch of points into a cover tree forest."""

    def __init__(self, forest):
        self.forest = forest

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count():
            self.forest = self.forest.insert(batch)
