"""Streaming duplicates: the first arrival of a vendor and document number passes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import truthy
from ..session import SETTINGS
from ..sources.files import exists
from ..sources.sinks import part_of


def first_arrivals(docs: DataFrame, vendor: str = "vendor", document_no: str = "document_no",
                   arrival: str = "arrival", doc_id: str = "doc_id",
                   horizon: str = "365 days", salts: int = 16) -> DataFrame:
    """Drop repeats of a key within the horizon of arrival time.

    The first pass works per key and salt and lets at most `salts` rows of a key through, so
    a key that many documents share never reaches one task in full. The state spans the
    horizon and is kept in RocksDB (`session.SETTINGS`). Which row of a micro-batch arrives first
    is not defined by Spark: use `passing` for the earliest of each batch. Rows later
    than the watermark are left to the batch check.
    """
    keyed = docs.withWatermark(arrival, horizon).withColumn(
        "_salt", F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int"))
    return (
        keyed.dropDuplicatesWithinWatermark([vendor, document_no, "_salt"])
        .dropDuplicatesWithinWatermark([vendor, document_no])
        .drop("_salt")
    )


# First arrivals with state ----------------------------------------------------------------

ROCKS_DB = "spark.sql.streaming.stateStore.providerClass"
_PASSED = "doc_id {id}, vendor STRING, document_no STRING, arrival TIMESTAMP"
_FIRST = "doc_id {id}, vendor STRING, document_no STRING, at LONG"


class FirstArrivals(StatefulProcessor):
    """State of a key: the days on which an arrival has passed. A timer of event time drops the days that no
    later arrival can be near to, and with the last of them the key."""

    def __init__(self, horizon_days: int):
        self.horizon = horizon_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", "day LONG")

    def _known(self) -> list[int]:
        return [int(row[0]) for row in self.days.get()]

    def _passing(self, first: dict[int, tuple], known: list[int]) -> list[tuple]:
        """Of the first rows by day those that are near to no known day; their days are added to `known`."""
        passed = []
        for day in sorted(first):
            if all(abs(day - k) > self.horizon for k in known):
                known.append(day)
                passed.append(first[day])
        return passed

    def _keep(self, days: list[int]) -> None:
        if days:
            self.days.put([(d,) for d in days])
            # Within a day after the horizon of the earliest.
            self.handle.registerTimer((min(days) + self.horizon + 1) * 86_400_000)
        else:
            self.days.clear()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep(sorted({*self._known(), initialState["day"]}))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: dict[int, tuple] = {}  # the first row of each day is kept, however many arrive
        for row in rows:
            own = (row["at"], row["doc_id"])
            if row["day"] not in first or own < first[row["day"]]:
                first[row["day"]] = own
        known = self._known()
        passed = self._passing(first, known)
        if passed:
            self._keep(sorted(known))
        for at, doc_id in passed:
            yield Row(doc_id=doc_id, vendor=key[0], document_no=key[1], at=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        gone = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000 - self.horizon
        self._keep([d for d in self._known() if d >= gone])
        return iter([])

    def close(self) -> None:
        pass


#: Hash buckets of the keys, and parts of a bucket's state from which on they are written as one.
BUCKETS, PARTS = 1 << 12, 16
_PART = "vendor ARRAY<STRING>, document_no ARRAY<STRING>, day ARRAY<LONG>"


class BucketArrivals(FirstArrivals):
    """The same for all keys of a hash bucket at once. Each call between worker and state takes far longer than
    the choice itself, so the calls of a batch grow with the buckets it touches, not with its keys. The state is a
    list of parts, each with the days that one batch has let through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", _PART)

    def _read(self) -> tuple[int, list[tuple]]:
        parts = list(self.parts.get())
        return len(parts), [entry for part in parts for entry in zip(*part)]

    def _add(self, count: int, known: list[tuple], new: list[tuple]) -> None:
        """Entries (vendor, document_no, day) beside the known ones; the timer is that of the earliest day."""
        if count < PARTS:
            self.parts.appendList([tuple(map(list, zip(*new)))])
        else:
            self.parts.put([tuple(map(list, zip(*known, *new)))])
        earliest = min(day for _, _, day in new)
        if not known or earliest < min(day for _, _, day in known):
            self._wait(earliest)

    def _wait(self, earliest: int) -> None:
        self.handle.registerTimer((earliest + self.horizon + 1) * 86_400_000)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        count, known = self._read()
        self._add(count, known, list(zip(initialState["vendors"], initialState["numbers"], initialState["days"])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: dict[tuple, dict[int, tuple]] = {}  # the first row of each key and day, however many arrive
        for row in rows:
            days, own = first.setdefault((row["vendor"], row["document_no"]), {}), (row["at"], row["doc_id"])
            if row["day"] not in days or own < days[row["day"]]:
                days[row["day"]] = own
        count, known = self._read()
        near: dict[tuple, list[int]] = {of: [] for of in first}
        for vendor, number, day in known:
            if (vendor, number) in near:
                near[vendor, number].append(day)
        new, passed = [], []
        for of, days in first.items():
            before = len(near[of])
            passed += [Row(doc_id=doc_id, vendor=of[0], document_no=of[1], at=at) for at, doc_id in self._passing(days, near[of])]
            new += [(*of, day) for day in near[of][before:]]
        if new:
            self._add(count, known, new)
        return iter(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        gone = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000 - self.horizon
        kept = [entry for entry in self._read()[1] if entry[2] >= gone]
        if kept:
            self.parts.put([tuple(map(list, zip(*kept)))])
            self._wait(min(day for _, _, day in kept))
        else:
            self.parts.clear()
        return iter([])


def _day(arrival: str) -> Column:
    return F.unix_date(F.to_date(arrival)).cast("long")


def passing(docs: DataFrame, stored: DataFrame | None = None, vendor: str = "vendor", document_no: str = "document_no",
            arrival: str = "arrival", doc_id: str = "doc_id", horizon_days: int = 365, late: str = "30 days") -> DataFrame:
    """(doc_id, vendor, document_no, arrival) of the rows of a stream that are no duplicates.

    The earliest arrival of a key in a micro-batch passes, unless one has passed within the horizon; a key
    passes again beyond it. What has passed is kept as days in the state of its hash bucket (RocksDB), one of BUCKETS:
    a batch reads the buckets of its keys, and no stored rows. `stored` holds what passed before the checkpoint began. Rows without a key, an id or an arrival pass. Rows
    later than the watermark (`late` behind the latest arrival) are left to the batch check.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(vendor).cast("string").alias("vendor"),
                      F.col(document_no).cast("string").alias("document_no"), F.col(arrival).alias("arrival"))
    own = own.withWatermark("arrival", late)
    bucket = F.pmod(F.xxhash64("vendor", "document_no"), F.lit(BUCKETS)).cast("int").alias("bucket")
    keyed = truthy(F.col("vendor")) & truthy(F.col("document_no")) & F.col("doc_id").isNotNull() & F.col("arrival").isNotNull()
    keys = ["vendor", "document_no"]
    # A row costs little as a row: a data frame or calls of its own for each key would cost far more than its state.
    before = None
    if stored is not None:
        days = stored.filter(keyed).select(bucket, *keys, _day("arrival").alias("day")).distinct()
        listed = days.groupBy("bucket").agg(F.collect_list(F.struct(*keys, "day")).alias("of"))
        before = listed.select("bucket", F.col("of.vendor").alias("vendors"), F.col("of.document_no").alias("numbers"),
                               F.col("of.day").alias("days")).groupBy("bucket")
    rows = own.filter(keyed).select(bucket, "*", F.unix_micros("arrival").alias("at"), _day("arrival").alias("day"))
    passed = rows.groupBy("bucket").transformWithState(
        BucketArrivals(horizon_days), _FIRST.format(id=dict(docs.dtypes)[doc_id]), "Append", "EventTime", before)
    return passed.select("doc_id", *keys, F.timestamp_micros("at").alias("arrival")).union(
        own.filter(~F.coalesce(keyed, F.lit(False))).select("doc_id", *keys, "arrival"))


def start_first_arrivals(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Add the first arrivals of a stream to a table, until there is nothing new.

    What the table holds seeds the state of a new checkpoint, and writes are keyed by the query, whose id lives in its
    checkpoint, and the batch: a restart goes on, a repeated batch replaces itself, and a new
    checkpoint deletes nothing.
    """
    spark, stored = docs.sparkSession, None
    # Keyed state of several parts is kept in RocksDB only.
    spark.conf.set(ROCKS_DB, SETTINGS[ROCKS_DB])
    if exists(spark, path) and not exists(spark, f"{checkpoint}/offsets"):
        kind = dict(docs.dtypes)[options.get("doc_id", "doc_id")]
        stored = spark.read.schema(_PASSED.format(id=kind)).option("recursiveFileLookup", "true").parquet(path)

    def save(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{path}/{part_of(run, batch_id)}")

    return passing(docs, stored, **options).writeStream.outputMode("append").foreachBatch(save).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
