"""Keeper ranking inside duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import rank_within


def duration_bucket(epsilon: float) -> Column:
    """Duration rounded half-even to steps of ``epsilon``; 0 for images and unknown durations."""
    known = (F.col("type") == "video") & (F.col("duration") > 0)
    return F.when(known, F.rint(F.col("duration") / epsilon) * epsilon).otherwise(0.0)


def quality_key() -> Column:
    """Bytes a second for videos, bytes otherwise."""
    return F.when((F.col("type") == "video") & (F.col("duration") > 0), F.col("size") / F.col("duration")).otherwise(F.col("size").cast("double"))


def resolution() -> Column:
    return (F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).cast("long")


def keeper_rank(groups: DataFrame, index: DataFrame, epsilon: float = 1.5) -> DataFrame:
    """Members of each group from the best to keep: longest, largest, highest quality, newest, least id."""
    g = groups.join(index, "asset_id").withColumns({"duration_bucket": duration_bucket(epsilon), "resolution": resolution(), "quality_key": quality_key()})
    g = g.select("asset_id", "group_id", "path", "duration_bucket", "resolution", "quality_key", "mtime")
    r = rank_within(g, "group_id", [F.desc("duration_bucket"), F.desc("resolution"), F.desc("quality_key"), F.desc("mtime"), "asset_id"])
    return r.select("asset_id", "group_id", "path", "rank", (F.col("rank") == 0).alias("is_keeper"), "duration_bucket", "resolution", "quality_key", "mtime")
