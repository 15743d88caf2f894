"""Frame sampling over timestamped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sample(events: DataFrame, step: Column, spans: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select(F.col("user_id").alias("asset_id"), "event_id", at.alias("t")).join(spans, "asset_id")
    e = e.withColumn("frame_index", F.floor((F.col("t") - F.col("t0")) / F.lit(1000000.0) / step))
    return e.groupBy("asset_id", "frame_index").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"))


def _spans(events: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("user_id").alias("asset_id")).agg(F.min(at).alias("t0"), ((F.max(at) - F.min(at)) / F.lit(1000000.0)).alias("dur"))


def sample_sparse(events: DataFrame, max_frames: int, max_rate: float) -> DataFrame:
    """First row of each interval; an asset's interval gives at most ``max_frames`` and ``max_rate`` a second.

    An asset without a positive duration has one row, its first.
    """
    return _sample(events, F.greatest(F.col("dur") / max_frames, F.lit(1.0 / max_rate)), _spans(events))


def sample_dense(events: DataFrame, interval: float) -> DataFrame:
    return _sample(events, F.lit(interval), _spans(events))
