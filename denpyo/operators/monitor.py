"""Run monitoring over a table of runs (timestamp, result code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counts(runs: DataFrame, now: str, ts: str = "ts", code: str = "code",
               hours: int = 1) -> DataFrame:
    """Runs per result code in the last hours before `now`."""
    start = F.lit(now).cast(runs.schema[ts].dataType) - F.expr(f"interval {hours} hours")
    return runs.filter(F.col(ts) > start).groupBy(code).agg(F.count("*").alias("runs"))


def hourly_counts(runs: DataFrame, failed: str, ts: str = "ts", code: str = "code") -> DataFrame:
    """Runs and failed runs per hour."""
    return (
        runs.groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(F.count("*").alias("runs"), F.count_if(F.col(code) == failed).alias("failures"))
        .select(F.col("w.start").alias("hour"), "runs", "failures")
    )


def recent_failures(runs: DataFrame, now: str, failed: str, ts: str = "ts", code: str = "code",
                    hours: int = 24) -> DataFrame:
    """Failed runs of the last hours before `now`, newest first."""
    start = F.lit(now).cast(runs.schema[ts].dataType) - F.expr(f"interval {hours} hours")
    return runs.filter((F.col(ts) > start) & (F.col(code) == failed)).orderBy(F.desc(ts))


def rule_usage(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents per type, target and source key: which rules the documents really use."""
    return (
        matches.join(docs.select("doc_id", "doc_type"), "doc_id")
        .groupBy("doc_type", "target", "key")
        .agg(F.count("*").alias("documents"))
    )
