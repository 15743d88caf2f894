"""Streaming twins: incremental stages, duplicates within a watermark, window sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.media import read_or_empty


def run_incremental(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, id_col: str = "asset_id", once: bool = True) -> StreamingQuery:
    """Run ``stage`` on rows whose id has no output yet and append what it gives; a retried batch adds nothing twice.

    Of the output only ids are read, and only the row groups whose range of ids meets the batch's.
    """
    spark = stream.sparkSession
    schema = stage(spark.createDataFrame([], stream.schema)).schema

    def batch(df: DataFrame, _: int) -> None:
        lo, hi = df.agg(F.min(id_col), F.max(id_col)).first()
        done = read_or_empty(spark, output, schema).select(id_col).filter(F.col(id_col).between(F.lit(lo), F.lit(hi)))
        stage(df.dropDuplicates([id_col]).join(done, id_col, "left_anti")).write.mode("append").parquet(output)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if once else w).start()


def first_of_content(stream: DataFrame, ts: str, delay: str, hash_col: str = "sha256") -> DataFrame:
    """Rows whose content has not been seen within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([hash_col])


def sample_windows(stream: DataFrame, ts: str, interval: str, delay: str, key: str, value: str) -> DataFrame:
    """The first row of each tumbling window and key."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, interval).alias("w"), key)
    return w.agg(F.min_by(value, F.struct(ts, value)).alias(value), F.min(ts).alias("first_ts")).select(F.col("w.start").alias("window_start"), key, value, "first_ts")
