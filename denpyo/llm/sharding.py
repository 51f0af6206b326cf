"""Sharding by extendible hashing, with DataFrame operations only.

Method: a document's hash is read bit by bit. The directory starts with one bucket of all
documents; a bucket of more than the byte limit is split on the next bit, all others stay, until
every bucket fits. A shard is the shortest hash prefix whose documents fit.

How it is done without a pass over the documents for each bit: document sizes are first summed
for cells of a fixed number of bits (combined before the shuffle), a few times as many cells as
there will be shards. Prefix sums, splits and directory come from the cells alone. Documents
are read twice in narrow form: once for the cells, once to look their cell up in the directory.
Cells that are too large themselves get a directory of their own with more bits, for their
documents only.

Results by case: a null text has 0 bytes; rows with a null id are hashed like an empty id; rows
with the same id have the same hash and stay together, and so do a single document's bytes: a
bucket that no bit can split any more stays above the limit, with `fits` false. An empty table has
no shard. The hash is the first 60 bits of the id's MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 60
#: Cells have so many bits more than the average shard.
SLACK = 4


def hash_bits(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _label(prefix: Column, depth: Column) -> Column:
    """The prefix as text of `depth` binary digits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))


def _directory(cells: DataFrame, first: int, last: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(buckets, deep) from cells (cell, bytes, docs) of `last` bits, all buckets of `first` bits
    being too large already unless first is 0.

    buckets (depth, prefix, bytes, docs): the shortest prefixes that fit. deep (cell): cells that
    do not.
    """
    levels = cells.select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"), "cell", "bytes", "docs")
    sizes = levels.groupBy("depth", F.expr(f"shiftright(cell, {last} - depth)").alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    sizes = stored(sizes, "shard-sizes")
    large = sizes.filter(F.col("bytes") > limit)
    parents = large.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fitting = sizes.filter(F.col("bytes") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    split = fitting.filter(F.col("depth") > first).join(parents, ["depth", "parent"], "left_semi")
    whole = fitting.filter(F.col("depth") == first) if first == 0 else fitting.limit(0)
    buckets = split.union(whole.select(split.columns)).select("depth", "prefix", "bytes", "docs")
    return buckets, large.filter(F.col("depth") == last).select(F.col("prefix").alias("cell"), "bytes", "docs")


def assign(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits) for documents (doc_id, text)."""
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(F.col("doc_id")).alias("hash"))
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first, last = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    out = None
    while True:
        cell = F.expr(f"shiftright(hash, {BITS - last})")
        here = rows.withColumn("cell", cell)
        cells = here.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        buckets, deep = _directory(stored(cells, "shard-cells"), first, last, limit)
        if last == BITS:
            rest = deep.select(F.lit(BITS).alias("depth"), F.col("cell").alias("prefix"), "bytes", "docs")
            buckets = buckets.union(rest)
        # The directory itself: an entry for each cell that a bucket covers.
        entries = buckets.select(
            F.explode(F.expr(f"sequence(shiftleft(prefix, {last} - depth), shiftleft(prefix + 1, {last} - depth) - 1)")).alias("cell"),
            _label(F.col("prefix"), F.col("depth")).alias("shard"), "depth",
            F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
        part = here.join(entries, "cell").select(
            "doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs",
            (F.col("shard_bytes") <= limit).alias("fits"))
        out = part if out is None else out.union(part)
        if last == BITS or deep.isEmpty():
            return out
        rows = stored(here.join(deep.select("cell"), "cell", "left_semi").select("doc_id", "n_bytes", "hash"), "shard-rows")
        first, last = last, min(BITS, last + 2 * SLACK)


def write_shards(docs: DataFrame, limit: int, path: str) -> str:
    """The documents with all their columns as Parquet, one folder for each shard. Returns the name of the column that
    the folders stand for: `shard`, or the first of shard_1, shard_2, ... that no column of docs has."""
    names = [c.lower() for c in docs.columns]
    free = [n for n in ("shard", *(f"shard_{i}" for i in range(1, len(names) + 3))) if n not in names]
    name, key = free[0], free[1]
    shards = assign(docs, limit).select(F.col("doc_id").alias(key), F.col("shard").alias(name)).distinct()
    held = docs.join(shards, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    held.repartition(name).sortWithinPartitions(name).write.partitionBy(name).parquet(path)
    return name
