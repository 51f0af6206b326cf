"""From raw documents to token ids: the stages of a training corpus, each on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denpyo.llm import byte_bpe, decontaminate, jaccard_join, language_id, quality
from denpyo.llm.common import keyed, relieve, stored, table, without_rows
from denpyo.llm.queries import BPE_RANKS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language that the evidence agrees on, foreign ones included, go."""
    rows, key = keyed(docs)
    said = rows.select(F.col(key).alias("key"), "text", F.col("lang").alias("declared"),
                       F.lit(None).cast("string").alias("url"), F.col("source").alias("host"))
    judged = language_id.identify(said, language_id.fit(docs))
    return without_rows(rows, key, judged.filter("NOT accepted").select(F.col("key").alias(key)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts bad go."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays, once. Rows are told apart by a key
    of their own, so an id that stands for several texts loses none that is not similar to another."""
    relieve(spark)
    rows, key = keyed(docs)
    classes = jaccard_join.similar_documents(rows.select(F.col(key).alias("doc_id"), "text")).select(
        F.col("doc_id").alias(key), "component_id")
    many = stored(classes, "classes")
    many = many.join(many.groupBy("component_id").count().filter("count > 1").select("component_id"), "component_id", "left_semi")
    many = stored(many.join(rows.select(key, "doc_id"), key), "members")
    first = many.groupBy("component_id").agg(F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("kept"))
    return without_rows(rows, key, many.join(first, "component_id").filter(F.col(key) != F.col("kept")).select(key))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a twentieth or more of their words from the benchmark go."""
    relieve(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left. Blocks are small and stored before their
    words are joined: the stages before have left an executor's memory to the JVM."""
    relieve(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN, block=1 << 20, remembered=150_000, apart=True)


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: Model fits, similarity components and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
