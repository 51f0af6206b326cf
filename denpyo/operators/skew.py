"""Joins on names of which a few own a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names looked at, items the sketch tracks, rows of one name that stay together.
HOT_NAMES, TRACKED, HOT_ROWS = 100, 10_000, 200_000
#: Rows of a master that are broadcast at most, and bytes of their texts.
MASTER_ROWS, MASTER_BYTES = 200_000, 16 << 20


def small(df: DataFrame) -> bool:
    """Whether a table is counted to be small enough for a broadcast."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(0)).cast("long")
                for n, t in df.dtypes if t == "string"), F.lit(0).cast("long"))
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    return rows <= MASTER_ROWS and (total or 0) <= MASTER_BYTES


def hot_pieces(df: DataFrame, key: str) -> dict[str, int]:
    """Name -> pieces of at most some HOT_ROWS rows, for the names that have more. One pass with a
    sketch of the most frequent names, merged from all partitions."""
    top = F.call_function("approx_top_k", F.col(key), F.lit(HOT_NAMES), F.lit(TRACKED))
    found = df.filter(F.col(key).isNotNull()).agg(top.alias("top")).first()["top"] or []
    return {r["item"]: -(-r["count"] // HOT_ROWS) for r in found if r["count"] > HOT_ROWS}


def spread(left: DataFrame, right: DataFrame, key: str, row_id: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, join columns): rows of hot names are dealt to pieces on the left, and the names'
    rows on the right are repeated for each piece. All other rows stay as they are."""
    pieces = hot_pieces(left, key)
    if not pieces:
        return left, right, [key]
    known = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])
    count = F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1))
    salt = F.pmod(F.xxhash64(F.col(row_id)), count).cast("int")
    every = F.explode(F.sequence(F.lit(0), count - 1))
    return left.withColumn("_salt", salt), right.withColumn("_salt", every), [key, "_salt"]
