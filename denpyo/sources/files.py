"""Document files: listing, batch reads and file streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application under the shared folder that the session names.

    Executors and driver must see it, so there is no local fallback.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/denpyo/{context.applicationId}"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one stored stage."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when no result is read any more."""
    remove(spark, scratch_root(spark))


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def materialize(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Needed between expensive per-row stages and joins, filters or grouping on their results:
    the optimizer pushes such conditions below the stages and would evaluate them once more
    for every condition.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, size, last_modified) of all files below a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path)
        .select(F.col("path").alias("name"), F.col("length").alias("size"),
                F.col("modificationTime").alias("last_modified"))
    )


def read_text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One document per file: (doc_id = path, raw_text)."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw_text"))
    )


RECORD_SCHEMA = "doc_id STRING, payload STRING"
#: A line that is no such JSON keeps its text, and every record names its file.
_LINE_SCHEMA = RECORD_SCHEMA + ", _corrupt STRING"


def _records(lines: DataFrame) -> DataFrame:
    """(doc_id, payload, source_file). A broken line becomes a record of its own, with the file and
    the line's hash as id and its text as payload, so that it ends as a traceable error."""
    broken = F.concat(F.col("source_file"), F.lit("#"), F.lower(F.hex(F.xxhash64("_corrupt"))))
    return lines.select(
        F.when(F.col("_corrupt").isNotNull(), broken).otherwise(F.col("doc_id")).alias("doc_id"),
        F.coalesce("payload", "_corrupt").alias("payload"), "source_file")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (doc_id, payload)."""
    reader = spark.read.schema(_LINE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt")
    return _records(reader.json(path).select("*", F.col("_metadata.file_path").alias("source_file")))


def _stream(spark: SparkSession, max_files: int, archive: str | None):
    reader = (
        spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    )
    if archive:
        # Files of a batch are moved when the next one begins, by the thread that plans it.
        spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader


def stream_records(spark: SparkSession, inbox: str, max_files: int = 1000,
                   archive: str | None = None) -> DataFrame:
    """New files of JSON lines as a stream; read files go to `archive` if one is named."""
    reader = _stream(spark, max_files, archive).schema(_LINE_SCHEMA)
    lines = reader.option("columnNameOfCorruptRecord", "_corrupt").json(inbox)
    return _records(lines.select("*", F.col("_metadata.file_path").alias("source_file")))


def stream_files(spark: SparkSession, inbox: str, content: str = "payload", pattern: str = "*",
                 max_files: int = 1000, archive: str | None = None, separator: str | None = None) -> DataFrame:
    """New files as a stream, one document per file: (doc_id = path, `content`, source_file).

    `content` is "payload" for analysis JSON and "raw_text" for plain text. With a `separator` a file
    holds many documents, whose ids are the path and the hash of the text.
    """
    reader = _stream(spark, max_files, archive).option("pathGlobFilter", pattern)
    path, value = F.col("_metadata.file_path"), F.col("value")
    if separator is None:
        docs, doc_id = reader.text(inbox, wholetext=True), path
    else:
        docs = reader.text(inbox, lineSep=separator)
        doc_id = F.concat(path, F.lit("#"), F.lower(F.hex(F.xxhash64(value))))
    return docs.select(doc_id.alias("doc_id"), value.alias(content), path.alias("source_file"))
