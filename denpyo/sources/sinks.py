"""Results: stored rows, artifacts, audit with run totals, and keep-latest document tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truthy
from .files import exists, remove, scratch_dir


def document_id(run_ts: str, doc_id: str = "doc_id") -> Column:
    """{type}_{vendor}_{number} with spaces as underscores; without vendor or number the run
    time and the input's key instead."""
    doc_type = F.coalesce(F.col("doc.type"), F.lit("UNKNOWN"))
    vendor, number = F.col("doc.vendor"), F.col("doc.document_no")
    stamp = F.date_format(F.lit(run_ts).cast("timestamp"), "yyyyMMddHHmmss")
    full = F.replace(F.concat_ws("_", doc_type, vendor, number), F.lit(" "), F.lit("_"))
    return F.when(truthy(vendor) & truthy(number), full).otherwise(
        F.concat_ws("_", doc_type, stamp, F.col(doc_id).cast("string")))


def stored_rows(df: DataFrame, run_ts: str) -> DataFrame:
    """Flat row per canonical document, with the whole document as a struct."""
    have = df.schema["doc"].dataType.names

    def doc(name: str) -> Column:
        return F.col(f"doc.{name}") if name in have else F.lit(None).cast("string")

    return df.filter(F.col("doc").isNotNull()).select(
        "doc_id",
        document_id(run_ts).alias("id"),
        F.coalesce(doc("vendor"), F.lit("unknown")).alias("partition_key"),
        doc("type").alias("doc_type"),
        doc("document_no").alias("document_no"),
        doc("issue_date").alias("issue_date"),
        doc("due_date").alias("due_date"),
        doc("vendor").alias("vendor"),
        doc("vendor_id").alias("vendor_id"),
        doc("customer_id").alias("customer_id"),
        doc("currency").alias("currency"),
        "totals",
        F.size("lines").alias("line_item_count"),
        doc("extraction_timestamp").alias("extraction_timestamp"),
        F.lit(run_ts).alias("created_at"),
        "metadata",
        F.struct("doc", "lines", "totals", "metadata").alias("full_document"),
    )


def artifact_rows(df: DataFrame) -> DataFrame:
    """(doc_id, kind, body): raw, cdm and validation JSON; cdm only where there is one."""
    raw = F.to_json(F.struct("doc_id", "doc_type", "entries", "conf", "tables", "raw_text"))
    cdm = F.to_json(F.struct("doc_id", "doc", "lines", "totals", "metadata"))
    validation = F.to_json(F.struct(
        "doc_id", "errors",
        F.array(F.struct(F.lit("classification").alias("step"), "doc_type", "vendor",
                         "confidence")).alias("info")))

    def artifact(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"))

    all_kinds = F.array(
        artifact("raw", raw),
        F.when(F.col("doc").isNotNull(), artifact("cdm", cdm)),
        artifact("validation", validation),
    )
    return df.select("doc_id", F.explode(F.array_compact(all_kinds)).alias("a")).select(
        "doc_id", "a.kind", "a.body")


def part_of(run: str, batch: int) -> str:
    """Folder of one batch of one run. Writing it again replaces that batch and nothing else."""
    return f"run={re.sub('[^0-9A-Za-z]+', '-', run)}/batch={batch:09d}"


_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_artifacts(df: DataFrame, path: str, run_ts: str, run: str, batch: int) -> None:
    """All artifacts in one job, one JSON document per line, by run, batch and kind. A task keeps the files of
    all kinds open, so that the texts need not be sorted by kind, and compresses them."""
    spark = df.sparkSession
    before = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, "8")
    try:
        (
            artifact_rows(df)
            .select(F.col("body").alias("value"), "kind", F.lit(run_ts[:10]).alias("run_date"))
            .write.mode("overwrite").option("compression", "gzip").partitionBy("kind", "run_date").text(
                f"{path}/{part_of(run, batch)}")
        )
    finally:
        spark.conf.set(_OPEN_FILES, before)


def audit_rows(df: DataFrame, run_ts: str) -> DataFrame:
    """(doc_id, processed_at, success, is_valid, error_count, warning_count). `success` means
    that there is a canonical document, valid or not."""
    return df.select(
        "doc_id",
        F.lit(run_ts).alias("processed_at"),
        F.col("doc").isNotNull().alias("success"),
        "is_valid",
        F.size("errors").alias("error_count"),
        F.lit(0).alias("warning_count"),
    )


def write_audit(df: DataFrame, path: str, run_ts: str, run: str, batch: int) -> None:
    audit_rows(df, run_ts).write.mode("overwrite").parquet(f"{path}/{part_of(run, batch)}")


TOTALS = "run STRING, batch LONG, processed_at STRING, documents LONG, successes LONG, valid LONG, errors LONG"


def write_results(df: DataFrame, path: str, totals: str, run_ts: str, run: str, batch: int) -> dict[str, int]:
    """Write one batch of results, and its totals as one row (TOTALS). The totals are observed by the
    job that writes; nothing is read again."""
    seen = Observation(f"{run}-{batch}")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    observed = df.observe(
        seen, F.count("*").alias("documents"), count(F.col("doc").isNotNull()).alias("successes"),
        count(F.col("is_valid")).alias("valid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))
    observed.write.mode("overwrite").parquet(f"{path}/{part_of(run, batch)}")
    # An empty batch may run no task, which then has nothing to tell.
    found = {n: int(seen.get.get(n) or 0) for n in ("documents", "successes", "valid", "errors")}
    row = df.sparkSession.createDataFrame([(run, batch, run_ts, *found.values())], TOTALS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{totals}/{part_of(run, batch)}")
    return found


def run_totals(spark: SparkSession, totals: str) -> DataFrame:
    """(run, documents, successes, valid, errors) of every run, from the rows of its batches."""
    rows = spark.read.schema(TOTALS).option("recursiveFileLookup", "true").parquet(totals)
    return rows.groupBy("run").agg(*[F.sum(n).alias(n) for n in ("documents", "successes", "valid", "errors")])


# Keep-latest tables -----------------------------------------------------------------------
#
# `merge_documents` keeps only the current version of each document, in hash buckets of its id; reading
# needs no join, and one document is found in one bucket. `upsert_documents` keeps all versions; a batch
# costs its own size only, and readers choose the latest.


ORDER = ("created_at", "batch_no", "doc_id")


def latest(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("created_at", "doc_id"),
           row: tuple[str, ...] = ()) -> DataFrame:
    """Last version per key.

    The winner is chosen on narrow columns, reduced before they are shuffled, so versions of one
    key are never gathered in one place, and whole documents are neither sorted nor aggregated:
    they meet the winners in one join. `row` names columns that tell versions of equal order
    apart; without them all but one of such versions must be equal in full.
    """
    names = tuple(dict.fromkeys((*order, *row)))
    winner = rows.groupBy(key).agg(F.max(F.struct(*names)).alias("_w")).select(
        F.col(key).alias("_key"), *[F.col(f"_w.{n}").alias(f"_{n}") for n in names])
    match = F.col(key).eqNullSafe(F.col("_key"))
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"_{n}"))
    out = rows.join(winner, match).select(*rows.columns)
    return out if row else out.dropDuplicates([key])


#: Buckets of a new document table.
BUCKETS = 64


def bucket_of(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def merge_documents(rows: DataFrame, path: str, run: str, batch: int, buckets: int = BUCKETS) -> None:
    """Merge one batch of document versions into the table of current ones.

    The table is partitioned by the hash bucket of the id (`buckets` counts for a new table). Only the buckets
    of the batch's ids are read and written again, by a dynamic partition overwrite. The last version by
    creation time, then by batch number and input id stays, so a batch that is merged again changes
    nothing. Spark replaces a folder by deleting and renaming: if the driver is lost just then, the
    batch has to be merged again, with what `upsert_documents` has kept of the bucket.
    """
    spark = rows.sparkSession
    known = spark.read.parquet(path) if exists(spark, path) else None
    if known is not None:
        buckets = known.select("buckets").first()[0]
    count = F.lit(buckets).cast("int")
    stored = scratch_dir(spark, "batch")
    rows.withColumns({
        "batch_no": F.lit(batch).cast("long"), "buckets": count, "bucket": bucket_of(F.col("id"), count),
    }).write.parquet(stored)
    new = _placed(spark.read.parquet(stored))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
    folders = [stored]
    if touched:
        if known is not None:
            new = _placed(known.filter(F.col("bucket").isin(touched))).unionByName(new)
        merged = latest(new, order=ORDER, row=("_file", "_row")).drop("_file", "_row")
        if known is not None:  # the buckets are read before they are written again
            folders.append(scratch_dir(spark, "merged"))
            merged.write.parquet(folders[-1])
            merged = spark.read.parquet(folders[-1])
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "buckets", "bucket").parquet(path)
    for folder in folders:
        remove(spark, folder)


def current_documents(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """The current version of every document, or of those with the given ids, whose buckets alone are
    read."""
    rows = spark.read.parquet(path)
    if ids is not None:
        wanted = [bucket_of(F.lit(i), F.col("buckets")) for i in ids]
        rows = rows.filter(F.col("bucket").isin(*wanted) & F.col("id").isin(ids))
    return rows.drop("buckets", "bucket", "batch_no")


def upsert_documents(rows: DataFrame, path: str, run: str, batch: int) -> None:
    """Add one batch of document versions. A batch costs its own size, whatever the size of the
    table, and writing it again replaces it; readers see the latest versions."""
    rows.withColumn("batch_no", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
        f"{path}/{part_of(run, batch)}")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions with the place where each is stored."""
    return _placed(spark.read.parquet(path)).drop("run", "batch")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of files with the place where each is stored, which tells equal ones apart."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The current version of every document: the last by creation time, then by batch."""
    rows = latest(_versions(spark, path), order=ORDER, row=("_file", "_row"))
    return rows.drop("_file", "_row", "batch_no")


def compact_documents(spark: SparkSession, path: str, target: str) -> None:
    """Write only the current versions to a new table, sorted by type and vendor, so that reads of
    one vendor skip most row groups. Their batch numbers stay, so later batches still win."""
    rows = latest(_versions(spark, path), order=ORDER, row=("_file", "_row")).drop("_file", "_row")
    rows.sortWithinPartitions("doc_type", "partition_key", "id").write.mode("overwrite").parquet(
        f"{target}/{part_of('compacted', 0)}")
