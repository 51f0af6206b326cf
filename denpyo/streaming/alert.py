"""Sliding alert: average of a metric over the last minutes above a limit.

A window is reported when the watermark has passed it, so after the last event its windows wait for
more. A heartbeat, a row without a value, lets event time go on over a quiet period and closes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def high_average(metrics: DataFrame, ts: str = "ts", value: str = "value", limit: float = 5.0,
                 length: str = "5 minutes", every: str = "1 minute",
                 delay: str = "10 minutes") -> DataFrame:
    """Windows whose average exceeds the limit: (window_start, window_end, average)."""
    return (
        metrics.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, every).alias("w"))
        .agg(F.avg(value).alias("average"))
        .filter(F.col("average") > limit)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "average")
    )


HEARTBEAT = "ts TIMESTAMP, value DOUBLE"


def with_heartbeats(metrics: DataFrame, path: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """The stream (ts, value) and the heartbeats that arrive in a folder."""
    spark = metrics.sparkSession
    spark.createDataFrame([], HEARTBEAT).write.mode("append").parquet(path)  # the folder has to be there
    beats = spark.readStream.schema(HEARTBEAT).parquet(path)
    return metrics.select(F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).union(beats)


def heartbeat(spark: SparkSession, path: str, last: str, quiet: str = "30 minutes") -> None:
    """Say that nothing has come for a while after the last event: every window that ends so long before is
    closed by the next run. The quiet period is that of the windows and the watermark at least."""
    at = F.lit(last).cast("timestamp") + F.expr(f"interval {quiet}")
    spark.range(1).select(at.alias("ts"), F.lit(None).cast("double").alias("value")).coalesce(1).write.mode(
        "append").parquet(path)
