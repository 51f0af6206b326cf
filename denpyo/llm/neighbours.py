"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Method: every tree gives each vector a long hash string (signs of its products with random
orthogonal directions) and keeps the strings as a sorted array. A query descends each tree to
the strings that share its longest prefix; then all trees ascend together, one bit at a time,
until the vectors under the common depth are `candidates` in number (counted over the trees).
These are ranked by their exact inner product.

How many candidates: for a sample of `SAMPLE` queries one pass over all vectors finds the true
nearest, the bits they share with the query in each tree, and the counts at each depth. They tell
the recall of any number of candidates; the least from `candidates` on with a recall of `RECALL`
is taken, up to all vectors in all trees. Results always come from the forest; only the sample's recall is
measured by comparing with every vector.

How it is distributed: a tree's sorted array is cut at a short prefix, so that a piece has a
few times the entries that a query takes from one tree. Pieces of more than `PIECE` entries or
queries are cut again, and every query of a prefix meets every entry cut. First the pieces count
entries by depth, the counts of a query are added up over the trees, then the pieces rank what
lies under the query's depth. Queries that have too few entries at the cut ascend beyond it by the
sizes of the prefixes, and are ranked in every prefix that they then cover. Work per query follows
the candidates: hardly any growth for clustered vectors, a share of all vectors for isotropic ones.

Inner products are turned into angles by one more coordinate, which fills vectors up to the
largest norm. Equal vectors are one entry with the smallest ids that a result can hold, so a vector
with a third of all rows is no large piece, and no result is lost.

Results by case: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; repeated rows count once; ties go to
the smaller id; a query has fewer rows if there are fewer candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, sent, stored

TREES, HASH_BITS, CANDIDATES = 24, 48, 2_000
#: Queries whose recall is measured, and the least that it may be there (0.9 is due for all).
SAMPLE, RECALL = 128, 0.95
#: Depths below the cut that are counted.
DEPTHS = 20
PIECE = 1 << 15
SEED = 7


def _planes(width: int, trees: int) -> np.ndarray:
    """Directions (tree, HASH_BITS, width), orthogonal as far as the width allows."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.standard_normal((width, width)))[0].T for _ in range(-(-HASH_BITS // width))]
        out.append(np.vstack(blocks)[:HASH_BITS])
    return np.array(out)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>, k1, k2) of the vectors that take part; k1 and k2 identify v."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.filter(F.size("v") == (width["w"] if width else 0)).withColumn(
        "k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1)))


def _hashes(x: np.ndarray, largest: float, planes: np.ndarray) -> Iterator[np.ndarray]:
    """The hash strings of vectors in each tree, as numbers."""
    weights = (np.uint64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.uint64))
    rest = np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))
    full = np.hstack([x, rest[:, None]])
    for tree in planes:
        yield ((full @ tree.T) > 0).astype(np.uint64) @ weights


def _entries(classes: DataFrame, largest: float, trees: int, cut: int) -> DataFrame:
    """(tree, prefix, key, cid, asks, vector) for every class and tree."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy()
            x = flat.reshape(batch.num_rows, -1)
            if planes is None:
                planes = _planes(x.shape[1] + 1, trees)
            vector = pa.array([row.tobytes() for row in x], pa.binary())
            for tree, key in enumerate(_hashes(x, largest, planes)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)),
                     pa.array((key >> np.uint64(HASH_BITS - cut)).astype(np.int64)), pa.array(key.astype(np.int64)),
                     batch.column(0), batch.column(1), vector],
                    ["tree", "prefix", "key", "cid", "asks", "vector"])

    return classes.select("cid", "asks", "v").mapInArrow(
        hash_all, "tree INT, prefix LONG, key LONG, cid LONG, asks BOOLEAN, vector BINARY")


def _pieces(rows: DataFrame) -> DataFrame:
    """rows with `entry`, and with `piece`: entries and queries of a prefix, in bounded cuts.

    An entry goes to every cut of the prefix's queries and a query to every cut of its entries.
    """
    sizes = rows.groupBy("tree", "prefix").agg(
        F.ceil(F.count(F.when(F.col("entry"), 1)) / PIECE).alias("by_entry"),
        F.ceil(F.count(F.when(~F.col("entry"), 1)) / PIECE).alias("by_query"))
    cuts = F.greatest(F.lit(1), F.when(F.col("entry"), F.col("by_query")).otherwise(F.col("by_entry")))
    mine = F.greatest(F.lit(1), F.when(F.col("entry"), F.col("by_entry")).otherwise(F.col("by_query")))
    own = F.pmod(F.hash("cid"), mine.cast("int"))
    dealt = rows.join(sizes, ["tree", "prefix"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), cuts.cast("int") - 1)))
    return dealt.withColumn("piece", F.when(F.col("entry"), F.struct("own", "other")).otherwise(
        F.struct(F.col("other").alias("own"), F.col("own").alias("other")))).drop("own", "other", "by_entry", "by_query")


def _sorted(group: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table]:
    """(entries by key, their keys, queries) of a piece."""
    entry = group.column("entry")
    entries = group.filter(entry).sort_by("key")
    return entries, entries.column("key").to_numpy(), group.filter(pa.compute.invert(entry))


def _range(keys: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share `depth` bits with each key lie in the sorted array."""
    low = (key >> (HASH_BITS - depth)) << (HASH_BITS - depth)
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (1 << (HASH_BITS - depth)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row, ties to the smaller id."""
    k = min(k, scores.shape[1])
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(scores >= least[:, None])
    if len(r) > k * len(scores):
        order = np.lexsort((ids[c], -scores[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
    return r, c


def _enough(classes: DataFrame, size: int, largest: float, k: int, trees: int, candidates: int) -> tuple[int, float]:
    """(candidates, recall): the least number, from the given one on, whose recall on a sample of the queries is
    RECALL, or all vectors in all trees."""
    some = classes.filter("asks").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("cid", "v").collect()
    if not some:
        return candidates, 1.0
    own, q = np.array([r.cid for r in some]), np.array([r.v for r in some])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        planes = _planes(q.shape[1] + 1, trees)
        asked = [key.astype(np.int64) for key in _hashes(q, largest, planes)]
        counts = np.zeros((len(q), HASH_BITS + 1), np.int64)
        best: list[np.ndarray] = [np.empty((0, 3))] * len(q)  # (-score, cid, bits shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            scores = q @ x.T
            scores[own[:, None] == cid[None, :]] = -np.inf
            r, c = _best(scores, cid, k)
            shared = np.zeros(len(r), np.int64)
            for mine, key in zip(asked, _hashes(x, largest, planes)):
                key = key.astype(np.int64)
                shared = np.maximum(shared, HASH_BITS - np.frexp((mine[r] ^ key[c]).astype(np.float64))[1])
                key.sort()
                for d in range(HASH_BITS + 1):
                    low, high = _range(key, mine, d)
                    counts[:, d] += high - low
            for i in range(len(q)):
                at = r == i
                rows = np.column_stack([-scores[i, c[at]], cid[c[at]], shared[at]])
                rows = np.vstack([best[i], rows[np.isfinite(rows[:, 0])]])
                best[i] = rows[np.lexsort((rows[:, 1], rows[:, 0]))[:k]]
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(q)), pa.int32()), pa.array(counts.tolist(), pa.list_(pa.int64())),
                 pa.array([b[:, 0].tolist() for b in best], pa.list_(pa.float64())),
                 pa.array([b[:, 2].astype(int).tolist() for b in best], pa.list_(pa.int64()))],
                ["q", "counts", "far", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        far = [x for row in group.column("far").to_pylist() for x in row]
        bits = [x for row in group.column("bits").to_pylist() for x in row]
        order = np.argsort(far, kind="stable")[:k]
        counts = np.sum(group.column("counts").to_pylist(), axis=0)
        return pa.table([pa.array([counts.tolist()], pa.list_(pa.int64())),
                         pa.array([[bits[i] for i in order]], pa.list_(pa.int64()))], names=["counts", "bits"])

    rows = classes.select("cid", "v").mapInArrow(
        measure, "q INT, counts ARRAY<LONG>, far ARRAY<DOUBLE>, bits ARRAY<LONG>").groupBy("q").applyInArrow(
        merge, "counts ARRAY<LONG>, bits ARRAY<LONG>").collect()
    if not rows:
        return candidates, 1.0
    counts = np.array([r.counts for r in rows])
    while True:
        candidates = min(candidates, trees * size)
        depth = np.maximum((counts >= candidates).sum(axis=1) - 1, 0)  # counts fall with the depth
        recall = float(np.mean([b >= d for r, d in zip(rows, depth) for b in r.bits] or [True]))
        if recall >= RECALL or candidates == trees * size:
            return candidates, recall
        candidates += -(-candidates // 4)


def _forest(classes: DataFrame, size: int, largest: float, trees: int, candidates: int, keys: list[str]) -> DataFrame:
    """What the pieces rank: the entries, and each query in the prefixes that its depth covers."""
    # One level above the depth at which the trees hold the candidates of an average query.
    cut = max(0, int(math.log2(max(1.0, trees * size / candidates))) - 1)
    entries = _entries(classes, largest, trees, cut)
    top = min(HASH_BITS, cut + DEPTHS)
    depths = list(range(cut, top + 1))
    asked, narrow = entries.filter("asks").drop("asks"), entries.drop("asks", "vector")

    def count(group: pa.Table) -> pa.Table:
        _, known, asked = _sorted(group)
        key = asked.column("key").to_numpy()
        spans = [np.subtract(*_range(known, key, d)[::-1]) for d in depths]
        return pa.table([asked.column("cid"), *[pa.array(s.astype(np.int64)) for s in spans]],
                        names=["cid", *[f"d{d}" for d in depths]])

    both = narrow.withColumn("entry", F.lit(True)).union(asked.drop("vector").withColumn("entry", F.lit(False)))
    counted = _pieces(both).groupBy(*keys).applyInArrow(
        count, "cid LONG, " + ", ".join(f"d{d} LONG" for d in depths))
    totals = counted.groupBy("cid").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in depths])
    depth = F.lit(cut) if not cut else F.lit(None).cast("int")
    for d in depths:  # counts fall with the depth
        depth = F.when(F.col(f"d{d}") >= candidates, F.lit(d)).otherwise(depth)
    depth_of = stored(totals.select("cid", depth.alias("depth")), "vector-depths")
    placed = asked.join(depth_of.filter("depth IS NOT NULL"), "cid")
    short = depth_of.filter("depth IS NULL").select("cid")
    if not short.isEmpty():
        # Every prefix at the cut with those above it.
        cells = stored(narrow.groupBy("tree", "prefix").agg(F.count("*").alias("n")), "vector-cells")
        above = F.expr(f"shiftright(prefix, {cut} - depth)")
        climb = F.explode(F.sequence(F.lit(0), F.lit(cut - 1)))
        under = cells.withColumn("depth", climb).withColumn("above", above)
        sizes = sent(under.groupBy("tree", "depth", "above").agg(F.sum("n").alias("n")))
        mine = asked.join(sent(short), "cid")
        steps = mine.select("cid", "tree", "prefix").withColumn("depth", climb).withColumn("above", above)
        deepest = (
            steps.join(sizes, ["tree", "depth", "above"]).groupBy("cid", "depth").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= candidates).groupBy("cid").agg(F.max("depth").alias("depth")))
        # At depth 0 every tree holds every vector.
        climbed = mine.join(stored(deepest, "vector-climbs"), "cid").filter("depth > 0 OR tree = 0").withColumn("above", above)
        spread = climbed.drop("prefix").join(under.drop("n"), ["tree", "depth", "above"]).drop("above")
        placed = placed.unionByName(spread)
    known = entries.drop("asks").withColumn("depth", F.lit(0)).withColumn("entry", F.lit(True))
    return known.unionByName(placed.withColumn("entry", F.lit(False)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES,
           candidates: int = CANDIDATES, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (vec_id, embedding) found for
    each whose id is divisible by `every`, without itself. `candidates`: the least number. `report` is given what was
    measured: the number of vectors, candidates of a query and recall of the sample."""
    rows = stored(clean(vectors).distinct(), "vectors")
    # The smallest ids of equal vectors: more can not be in one result.
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = stored(rows.select("vec_id", "k1", "k2").distinct().withColumn("at", first).filter(F.col("at") <= k + 1), "vector-ids")
    named = few.filter("at = 1").select(F.col("vec_id").alias("cid"), "k1", "k2")
    members = few.join(named, ["k1", "k2"]).select("cid", "vec_id")
    queries = stored(
        rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2")
        .join(named, ["k1", "k2"]).select("query_id", "cid").distinct(), "vector-queries")
    asking = queries.select("cid").distinct().withColumn("asks", F.lit(True))
    one = rows.join(named.withColumnRenamed("cid", "vec_id"), ["vec_id", "k1", "k2"], "left_semi").dropDuplicates(["vec_id"])
    classes = stored(
        one.select(F.col("vec_id").alias("cid"), "v").join(asking, "cid", "left")
        .withColumn("asks", F.coalesce("asks", F.lit(False))), "vector-classes")
    size, largest = classes.agg(
        F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    largest = float(largest or 0.0)
    keys = ["tree", "prefix", "piece.own", "piece.other"]
    candidates = max(candidates, trees * (k + 1))  # else they could be fewer than k vectors
    candidates, recall = _enough(classes, size, largest, k, trees, candidates)
    if report is not None:
        report.update(vectors=size, candidates=candidates, recall=recall)
    ready = _forest(classes, size, largest, trees, candidates, keys)

    def rank(group: pa.Table) -> pa.Table:
        known, order, asked = _sorted(group)
        key, deep = asked.column("key").to_numpy(), asked.column("depth").to_numpy()
        if not len(known) or not len(asked):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["cid", "found", "score"])
        cid, own = known.column("cid").to_numpy(), asked.column("cid").to_numpy()
        read = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(len(t), -1)
        x, q = read(known), read(asked)
        out: list[tuple[np.ndarray, ...]] = []
        for d in np.unique(deep):
            at = np.flatnonzero(deep == d)
            low, high = _range(order, key[at], int(d))
            for a in np.unique(low):
                mine = at[low == a]
                b = int(high[low == a][0])
                for i in range(0, len(mine), 256):
                    some = mine[i:i + 256]
                    scores = q[some] @ x[a:b].T
                    r, c = _best(scores, cid[a:b], k + 1)
                    out.append((own[some][r], cid[a:b][c], scores[r, c]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table([pa.array(c) for c in cols], names=["cid", "found", "score"])

    ranked = _pieces(ready).groupBy(*keys).applyInArrow(rank, "cid LONG, found LONG, score DOUBLE")
    by_class = Window.partitionBy("cid").orderBy(F.desc("score"), "found")
    nearest = ranked.groupBy("cid", "found").agg(F.max("score").alias("score")).withColumn(
        "at", F.row_number().over(by_class)).filter(F.col("at") <= k + 1).drop("at")
    nearest = stored(nearest, "vector-nearest")

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = queries.join(nearest, "cid").join(members.withColumnRenamed("cid", "found"), "found")
    return (
        lists.filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
