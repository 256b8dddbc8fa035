"""Streams: scoring with a fitted model, windowed statistics, and running conjugate updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import gmm, kmeans


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def score_mixture(stream: DataFrame, cols: list[str], model: gmm.Mixture) -> DataFrame:
    """A projection, so it needs no state."""
    return gmm.score(stream, cols, model)


def assign_clusters(stream: DataFrame, cols: list[str], centroids: np.ndarray) -> DataFrame:
    return kmeans.assign(stream, cols, centroids)


def windowed_moments(stream: DataFrame, time: str, col: str, length: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of a window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(col).alias("s1"), F.sum(F.col(col) * F.col(col)).alias("s2"))


def running_normal(stream: DataFrame, key: str, col: str, mu0: float = 0.0, n0: float = 1.0) -> DataFrame:
    """Posterior mean and degrees by key: the update is a sum, so a running aggregate holds it."""
    s = stream.groupBy(key).agg(F.count(col).alias("n"), F.sum(col).alias("s1"))
    return s.select(key, ((F.lit(n0 * mu0) + F.col("s1")) / (F.col("n") + n0)).alias("mu"), (F.col("n") + n0).alias("degrees"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink of everything available now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
