"""Token counts: one exact histogram of encoded lengths answers totals for every context limit.

Method: documents are aggregated by encoded length. Sums over all longer lengths then give, for
any limit, how many documents fit, how many tokens there are, and how many remain if each
document is cut at the limit; sums over shorter ones give the quantiles.

The histogram has one row for each different length, whatever the number of documents, and counts
are combined before the shuffle. Sums run within ranges of `RANGE` lengths and then over the
few totals of the ranges, so no task reads the whole histogram.

Results by case: null and empty texts have length 0; repeated rows count each; an empty table
gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, stored, strings

RANGE = 1024


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(n_tokens) of each text under a rank file, special tokens read as ordinary text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(t)) if t else 0 for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens LONG")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) for each different length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(counts: DataFrame) -> DataFrame:
    """For each length L of a histogram, as a context limit:

    docs_longer and tokens_longer (documents of more than L tokens and their tokens),
    docs_within, tokens_within (of at most L), truncated_total (tokens if each document is cut
    at L), lost_tokens, quantile (share of documents of at most L tokens).
    """
    sums = (
        counts.withColumn("r", F.floor(F.col("n_tokens") / RANGE))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    )
    inside = Window.partitionBy("r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = sums.groupBy("r").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0).cast("long")
    ranges = ranges.select(
        "r", F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("all_tokens").over(above), zero).alias("tokens_above"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("all_tokens").over(everything).alias("total_tokens"))
    longer_docs = F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), zero)
    longer_tokens = F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), zero)
    return (
        sums.join(ranges, "r")
        .select("n_tokens", "n_docs", longer_docs.alias("docs_longer"), longer_tokens.alias("tokens_longer"),
                "total_docs", "total_tokens")
        .withColumn("docs_within", F.col("total_docs") - F.col("docs_longer"))
        .withColumn("tokens_within", F.col("total_tokens") - F.col("tokens_longer"))
        .withColumn("truncated_total", F.col("tokens_within") + F.col("n_tokens") * F.col("docs_longer"))
        .withColumn("lost_tokens", F.col("total_tokens") - F.col("truncated_total"))
        .withColumn("quantile", F.col("docs_within") / F.col("total_docs"))
        .drop("total_docs", "total_tokens")
    )


def truncated_total(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, truncated_total) for any limits, present as lengths or not."""
    return counts.agg(*[
        F.struct(
            F.lit(limit).alias("limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"),
        ).alias(f"l{i}") for i, limit in enumerate(limits)
    ]).select(F.inline(F.array(*[f"l{i}" for i in range(len(limits))])))


def quantile(counts: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least this share of the documents does not exceed."""
    return context_totals(counts).filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def stored_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram, stored once: totals and sums read it more than once."""
    return stored(histogram(lengths), "token-histogram")
