"""Session settings the stages are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates without a zone are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Skewed join partitions are split and small ones merged at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes of code. Stages with many rules are
    # then better generated operator by operator than fused into one long method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The state of a year of documents does not fit into executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Documents are texts that repeat: stored stages and results take half the disk.
    "spark.sql.parquet.compression.codec": "zstd",
    # Call sites are only recorded for error messages; plans of many columns build faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Apply to a running session what can be set there."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
