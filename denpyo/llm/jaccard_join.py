"""N-gram Jaccard join: documents whose word-shingle sets are similar, as components.

Method: grouped prefix join. A document's shingles are ordered rare first; the sets of two
similar documents of n and m shingles share one of the first n - ceil(n * threshold) + 1.
Documents with the same size and the same such prefix form one group, and only groups meet in
the inverted lists of prefix shingles. What the filters on size and position leave is expanded
to the groups' distinct sets and verified on the whole sets.

How it is distributed:

* Rare first needs counts of all shingles. They are counted in a table of 2^22 hashed
  counters, whose size does not depend on the input; any function of a shingle is a valid
  order, so collisions cost pruning and never a link.
* Documents are described once (size, signature, prefix); only one of each group is posted, so
  copies collapse before the shuffle. A posting list has one row for each group, and is read as
  a sorted stream.
* Many near copies of one text would give a quadratic number of pairs. As the result is the
  components, pairs are verified in rounds: first each set against one partner (linear), then
  every pair that is still in different components. No pair that could join two components
  is left out.
* Sets are built and travel only for the documents whose pairs are verified in a round.

Results by case: null or blank text has an empty set, is linked with nothing and is its own
component; rows without an id are returned with null component and take no part; rows that
repeat an id are one document if their texts are equal (with different texts, the id stands for
all of them); copies have equal sets and always link. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, bounded, lean, relieve, sent, shingle_sets, signed, stored, windows

#: Counters of the table that orders shingles by frequency, and rows it is summed in.
COUNTER_BITS, COUNTER_ROWS = 22, 1024
#: Partners that a member of a list is offered in a linear round.
HUBS = 16
#: A list up to this length is filtered by all its pairs before it is stored.
SHORT_LIST = 2048
#: Pairs a task remembers as offered.
PAIRS_KEPT = 1 << 16


def _ratio(threshold: float) -> tuple[int, int]:
    return round(threshold * 100), 100


def prefix_length(n, threshold: float):
    a, b = _ratio(threshold)
    return n - (a * n + b - 1) // b + 1


def least_overlap(n, m, threshold: float):
    """Smallest intersection with which sets of n and m reach the threshold."""
    a, b = _ratio(threshold)
    return (a * (n + m) + a + b - 1) // (a + b)


def _counts(docs: DataFrame, size: int) -> np.ndarray:
    """The order's main key for each counter: the power of two of its count over the mean."""
    per_row = (1 << COUNTER_BITS) // COUNTER_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, total = Words(SPACED), np.zeros(1 << COUNTER_BITS, np.uint32)
        shift = np.uint64(64 - COUNTER_BITS)
        for batch in batches:
            for _, chunk in words.chunks(batch.column(0)):
                # Windows over the end of a text count too; they only blur the order.
                if len(chunk.hashes) >= size:
                    np.add.at(total, (windows(chunk.hashes, size) >> shift).astype(np.int64), np.uint32(1))
        rows = [r for r in range(COUNTER_ROWS) if total[r * per_row:(r + 1) * per_row].any()]
        packed = [zlib.compress(total[r * per_row:(r + 1) * per_row].tobytes(), 1) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(packed, pa.binary())],
                                         ["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                sums[row] = sums.get(row, 0) + counts.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.sum() for v in sums.values()], pa.int64()),
             pa.array([np.floor(np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes()
                       for v in sums.values()], pa.binary())],
            ["row", "total", "logs"])

    # A row holds 4096 counters as one byte each, and there are 1024 rows at most.
    rows = (
        bounded(docs).select("text").mapInArrow(count, "row INT, counts BINARY")
        .repartition("row").mapInArrow(add, "row INT, total LONG, logs BINARY").collect()
    )
    logs = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in rows:
        logs[r.row * per_row:(r.row + 1) * per_row] = np.frombuffer(r.logs, np.uint8)
    mean = max(1.0, sum(r.total for r in rows) / len(logs))
    # Below the mean a count says nothing about a single shingle.
    return np.maximum(logs.astype(np.int16) - int(np.log2(mean)), 0).astype(np.uint8)


def _prefix(shingles: np.ndarray, levels: np.ndarray, threshold: float) -> np.ndarray:
    level = levels[(shingles >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")  # the shingles themselves are in order already
    return shingles[order[:prefix_length(len(shingles), threshold)]]


def _group_key(prefix: np.ndarray, n: int) -> int:
    return xxhash.xxh64_intdigest(prefix.tobytes(), seed=n) - (1 << 63)


def _documents(docs: DataFrame, levels, size: int, threshold: float) -> DataFrame:
    """(doc_id, n, s1, s2, g, prefix): size, 128-bit signature of the set, key of the prefix group."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, order = Words(SPACED), levels.value
        for batch in batches:
            out, prefixes = [], []
            for shingles in shingle_sets(batch.column(1), words, size):
                sign = xxhash.xxh3_128_intdigest(shingles.tobytes())
                prefix = _prefix(shingles, order, threshold) if len(shingles) else shingles
                key = _group_key(prefix, len(shingles)) if len(shingles) else 0
                out.append((len(shingles), (sign >> 64) - (1 << 63), (sign & (1 << 64) - 1) - (1 << 63), key))
                prefixes.append(signed(prefix))
            cols = list(zip(*out)) if out else [()] * 4
            ends = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.int64()) for c in cols] + [pa.ListArray.from_arrays(pa.array(ends), flat)],
                ["doc_id", "n", "s1", "s2", "g", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        describe, "doc_id LONG, n LONG, s1 LONG, s2 LONG, g LONG, prefix ARRAY<LONG>")


def _postings(described: DataFrame) -> DataFrame:
    """(token, g, n, pos) for each prefix shingle of each group, from one document of the group."""
    rows = described.filter("doc_id IS NOT NULL AND n > 0")
    # By id and set: an id with different texts can be first in one group and not in another.
    one = F.struct("doc_id", "s1", "s2")
    first = rows.groupBy("g").agg(F.min(one).alias("first"), F.count("*").alias("docs")).filter("docs > 1")
    others = rows.select("doc_id", "s1", "s2", "g").join(first.select("g", "first"), "g").filter(one != F.col("first"))
    others = sent(others.select("doc_id", "s1", "s2").distinct())
    return rows.join(others, ["doc_id", "s1", "s2"], "left_anti").select(
        "g", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).select(
        "token", "g", "n", "pos")


def _compatible(n, p, m, q, threshold: float):
    """Whether sizes n, m and positions p, q of a first common shingle allow the threshold."""
    a, b = _ratio(threshold)
    return ((np.minimum(n, m) * b >= a * np.maximum(n, m))
            & (np.minimum(n - p, m - q) >= least_overlap(n, m, threshold)))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The lists of two members or more of a stream sorted by token. Most have just two: those of a
    batch come together, as columns of shape (lists, 2), all others one by one."""
    pieces: list[dict[str, np.ndarray]] = []  # of the last token, which may go on

    def done(cols: dict[str, np.ndarray], cuts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        if len(two):
            yield {k: v[two[:, None] + np.arange(2)] for k, v in cols.items()}
        for i in np.flatnonzero(sizes > 2):
            yield {k: v[cuts[i]:cuts[i + 1]] for k, v in cols.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        token = cols["token"]
        if pieces and pieces[0]["token"][0] == token[0] == token[-1]:
            pieces.append(cols)
            continue
        if pieces:
            cols = {k: np.concatenate([p[k] for p in pieces] + [v]) for k, v in cols.items()}
            token = cols["token"]
        cuts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1]
        yield from done(cols, cuts)
        pieces = [{k: v[cuts[-1]:].copy() for k, v in cols.items()}]
    if pieces:
        cols = {k: np.concatenate([p[k] for p in pieces]) for k in pieces[0]}
        yield from done(cols, np.array([0, len(cols["token"])]))


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Short arrays as batches of some 100,000 rows."""
    held, count = [], 0
    for r in rows:
        held.append(r)
        count += len(r[0])
        if count >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, count = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _by_token(df: DataFrame) -> DataFrame:
    return df.repartition("token").sortWithinPartitions("token")


def _group_lists(postings: DataFrame, threshold: float) -> DataFrame:
    """Lists of two groups or more, without members that no other member can match."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        def rows():
            for one in _lists(batches):
                g, n, p = one["g"], one["n"].astype(np.int64), one["pos"].astype(np.int64)
                if g.ndim == 2:
                    kept = _compatible(n[:, 0], p[:, 0], n[:, 1], p[:, 1], threshold) & (g[:, 0] != g[:, 1])
                elif len(g) <= SHORT_LIST:
                    fit = _compatible(n[:, None], p[:, None], n[None, :], p[None, :], threshold)
                    kept = (fit & (g[:, None] != g[None, :])).any(axis=1)
                else:
                    kept = np.ones(len(g), bool)
                if kept.any():
                    yield tuple(one[c][kept].ravel() for c in ("token", "g", "n", "pos"))
        yield from _batches(rows(), ["token", "g", "n", "pos"])

    return _by_token(postings).mapInArrow(keep, "token LONG, g LONG, n INT, pos INT")


def _offers(lists: DataFrame, threshold: float, every: bool) -> DataFrame:
    """(a, b) with a < b from lists of (token, id, n, pos, comp): pairs of different components that
    the filters allow. `every`: all of them, else one for each member of a list."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        last: set[int] = set()

        def fresh(a: np.ndarray, b: np.ndarray):
            # The lists of one text's shingles offer the same pairs again and again.
            low, high = np.minimum(a, b), np.maximum(a, b)
            new = []
            for i, pair in enumerate(zip(low.tolist(), high.tolist())):
                if pair not in last:
                    if len(last) >= PAIRS_KEPT:
                        last.clear()
                    last.add(pair)
                    new.append(i)
            return low[new], high[new]

        def rows():
            for one in _lists(batches):
                comp = one["comp"]
                if comp.ndim == 2:
                    n, p, ids = one["n"].astype(np.int64), one["pos"].astype(np.int64), one["id"]
                    fit = _compatible(n[:, 0], p[:, 0], n[:, 1], p[:, 1], threshold) & (comp[:, 0] != comp[:, 1])
                    if fit.any():
                        yield fresh(ids[fit, 0], ids[fit, 1]) if every else (ids[fit].min(axis=1), ids[fit].max(axis=1))
                    continue
                if (comp == comp[0]).all():
                    continue
                sizes = np.unique(comp, return_inverse=True, return_counts=True)
                # Members of the largest component first: they need no comparison with each other.
                order = np.lexsort((one["id"], one["pos"], -sizes[2][sizes[1]]))
                ids, comp = one["id"][order], comp[order]
                n, p = one["n"][order].astype(np.int64), one["pos"][order].astype(np.int64)
                start = int((comp == comp[0]).sum()) if every else 0
                for i in range(start, len(ids), 512):
                    mine = slice(i, min(i + 512, len(ids)))
                    rest = slice(0, mine.stop) if every else slice(0, min(HUBS, len(ids)))
                    fit = _compatible(n[mine, None], p[mine, None], n[None, rest], p[None, rest], threshold)
                    fit &= comp[mine, None] != comp[None, rest]
                    if every:
                        x, y = np.nonzero(fit)
                        below = y < x + i
                        x, y = x[below], y[below]
                    else:
                        x = np.flatnonzero(fit.any(axis=1))
                        y = fit[x].argmax(axis=1)
                    if len(x):
                        a, b = ids[mine][x], ids[rest][y]
                        if every:
                            a, b = fresh(a, b)
                        else:
                            a, b = np.minimum(a, b), np.maximum(a, b)
                        if len(a):
                            yield a, b
        yield from _batches(rows(), ["a", "b"])

    return _by_token(lists).mapInArrow(offer, "a LONG, b LONG")


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows with their last column, a text, replaced by `shingles`, its set."""
    names = rows.columns[:-1]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words = Words(SPACED)
        for batch in batches:
            sets = [signed(s) for s in shingle_sets(batch.column(len(names)), words, size)]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names + ["shingles"])

    return rows.mapInArrow(build, ", ".join(f"{n} LONG" for n in names) + ", shingles ARRAY<LONG>")


def plausible(pairs: DataFrame, described: DataFrame, threshold: float) -> DataFrame:
    """The stored pairs (a, b) that their prefixes leave possible.

    Of two sets, take the one whose prefix ends first in the order: what its prefix shares with the
    other set lies in both prefixes, so the intersection is at most that and the rest of the set.
    """
    a, b = _ratio(threshold)
    own = described.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "prefix")
    seconds = own.join(sent(pairs, True).withColumnRenamed("b", "doc_id"), "doc_id").withColumnRenamed("doc_id", "b")
    firsts = own.join(sent(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").toDF("a", "m", "other")
    most = F.size(F.array_intersect("prefix", "other")) + F.greatest(
        F.col("n") - F.size("prefix"), F.col("m") - F.size("other"))
    return seconds.join(firsts, "a").filter(most * (a + b) >= a * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The stored pairs (a, b) whose whole sets reach the threshold.

    Sets are built where the texts lie and meet by the pair's first document: one trip for each
    pair and one for each first document.
    """
    a, b = _ratio(threshold)
    text = docs.select("doc_id", "text")
    seconds = text.join(sent(pairs, True).withColumnRenamed("b", "doc_id"), "doc_id")
    firsts = text.join(sent(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi")
    both = _with_sets(seconds.select("a", F.col("doc_id").alias("b"), "text"), size).join(
        _with_sets(firsts.select(F.col("doc_id").alias("a"), "text"), size).withColumnRenamed("shingles", "other"), "a")
    common = F.size(F.array_intersect("shingles", "other"))
    return both.select("a", "b", common.alias("common"), (F.size("shingles") + F.size("other")).alias("total")).filter(
        F.col("common") * b >= a * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id of an edge.

    Each step takes the smallest label among the neighbours, then the label of that label.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("id", "to").distinct(), "edges")
    labels = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.toDF("to", "near"), "to").groupBy("id").agg(F.min("near").alias("near"))
            .join(labels, "id").select("id", F.least("comp", "near").alias("next"), "comp")
        )
        jumped = near.join(labels.toDF("next", "far"), "next").select(
            "id", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved"))
        step = stored(jumped, "labels")
        relieve(edges.sparkSession)
        labels = step.select("id", "comp")
        if step.filter("moved").isEmpty():
            return labels


def similar_documents(docs: DataFrame, threshold: float = 0.8, size: int = 5, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    `rounds`: linear rounds before all remaining pairs are verified; the result does not
    depend on it.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = own.filter(F.col("doc_id").isNotNull())
    levels = spark.sparkContext.broadcast(_counts(named, size))
    described = stored(_documents(own, levels, size, threshold), "jaccard-documents")
    classes = (
        described.filter("doc_id IS NOT NULL AND n > 0").groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("id"), F.min("g").alias("g"))
    )
    classes = stored(classes, "jaccard-classes")

    found = stored(_group_lists(_postings(described), threshold), "jaccard-lists")
    members = classes.select("id", "g", F.col("n").cast("int").alias("n"))
    expanded = found.join(members.select("id", "g"), "g").select("token", "id", "n", "pos")
    # The distinct sets of one group share their whole prefix.
    inside = (
        members.join(members.groupBy("g").count().filter("count > 1").select("g"), "g", "left_semi")
        .select(F.col("g").alias("token"), "id", "n", F.lit(0).alias("pos"))
    )
    lists = stored(expanded.union(inside), "jaccard-members")

    labels = spark.createDataFrame([], "id LONG, comp LONG")
    tested = spark.createDataFrame([], "a LONG, b LONG")
    edges = tested
    for turn in range(rounds + 1):
        relieve(spark)  # each round leaves the plans and broadcasts of some dozens of jobs
        every = turn == rounds
        labelled = lists.join(sent(labels, True), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        offers = _offers(labelled.select("token", "id", "n", "pos", "comp"), threshold, every)
        if every:
            chosen = offers.distinct().join(tested, ["a", "b"], "left_anti")
        else:
            counted = offers.groupBy("a", "b").count().join(tested, ["a", "b"], "left_anti")
            chosen = counted.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")
        chosen = stored(chosen, "jaccard-pairs")
        tested = tested.union(chosen)
        left = stored(plausible(chosen, described, threshold), "jaccard-plausible")
        edges = stored(edges.union(verify(left, named, size, threshold)), "jaccard-links")
        labels = components(edges)

    return (
        described.join(classes.select("n", "s1", "s2", "id"), ["n", "s1", "s2"], "left")
        .join(sent(labels, True), "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id", "doc_id")).alias("component_id"))
    )
