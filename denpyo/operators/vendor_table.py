"""Vendors of a table of any size, found by a multi-pattern automaton (Aho and Corasick).

Texts and patterns are compared without blanks and dashes, as these are optional in phone numbers. A
pattern enters the automaton with as many of its first characters as tell it from its neighbours in
the sorted table; where these occur in a text, the whole pattern is tested. So a text is read once,
whatever the number of patterns, and no row is made for its parts.

The automaton is a few flat arrays in one Arrow buffer: transitions sorted by (state, character), and for each
state the state to fall back to, the nearest state that ends an anchor, and its patterns. All texts
of a batch walk it together, long ones in overlapping pieces, so each step is one array operation.

The table is cut into parts of counted bytes, each built by a task and broadcast; the best match of all
parts is the smallest (vendor_ord, pat_ord). `PARTS_AT_ONCE` parts are walked in one pass; beyond that the
best so far is stored between the passes, so a worker's memory is bounded for any table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize

#: Characters of an anchor at least, bytes of names and patterns of a part, parts held by a worker.
MIN_ANCHOR, PART_BYTES, PARTS_AT_ONCE = 8, 4 << 20, 4
#: Characters of a text that one lane walks.
LANE = 512
#: Bits of a character in a transition.
_CHAR = 21
_SEPARATORS = re.compile(r"[\-\s]+")
_META = re.compile(r"[.^$*+?{}\[\]\\|()]")
_FOUND = "vendor_ord BIGINT, pat_ord BIGINT, vendor STRING"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts in a row, where each text starts and the last one ends)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    return next(i for i in range(size) if a[i] != b[i])


def anchors(forms: list[str]) -> list[str]:
    """For each of some different sorted texts the beginning that tells it from the others, of
    MIN_ANCHOR characters at least."""
    shared = [0, *[_shared(a, b) for a, b in zip(forms, forms[1:])], 0]
    return [f[:max(MIN_ANCHOR, 1 + shared[i], 1 + shared[i + 1])] for i, f in enumerate(forms)]


def _next(keys: np.ndarray, fall: np.ndarray, state: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The states after one character each."""
    out = np.zeros(len(state), np.int64)
    left, at = np.arange(len(state)), state
    while len(left):
        key = at << _CHAR | char[left]
        place = np.searchsorted(keys, key)
        hit = keys[np.minimum(place, len(keys) - 1)] == key
        out[left[hit]] = place[hit] + 1
        more = ~hit & (at > 0)
        left, at = left[more], fall[at[more]]
    return out


def build(rows: list[tuple[int, int, str, str, bool]]) -> bytes:
    """The automaton of (vendor_ord, pat_ord, vendor, pattern, is a phone number) as an Arrow buffer."""
    rows = sorted(rows, key=lambda r: r[:3])
    # A phone pattern with other signs than digits and dashes is an expression, tested on every text.
    loose = [phone and "-" in p for *_, p, phone in rows]
    forms = ["" if flexible and _META.search(p) else _SEPARATORS.sub("", p) for (*_, p, _), flexible in zip(rows, loose)]
    different = sorted({f for f in forms if f})
    of_form = dict(zip(different, anchors(different)))
    names = sorted(set(of_form.values()))
    flat, ends = _codes(names)
    size, end = np.diff(ends), np.zeros(len(names), np.int64)
    keys, depths, count = [], [], 0
    depth = 0
    while True:
        on = np.flatnonzero(size > depth)
        if not len(on):
            break
        key = end[on] << _CHAR | flat[ends[on] + depth]
        new = np.r_[True, key[1:] != key[:-1]]
        end[on] = count + np.cumsum(new)
        keys.append(key[new])
        count += int(new.sum())
        depths.append(count)
        depth += 1
    keys = np.concatenate(keys) if keys else np.array([-1], np.int64)
    fall, nearest = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    node_of = dict(zip(names, end.tolist()))
    node = np.array([node_of[of_form[f]] if f else 0 for f in forms], np.int64)
    order = np.argsort(node, kind="stable")
    starts = np.searchsorted(node[order], np.arange(len(keys) + 2))
    mine = np.diff(starts) > 0
    before = 0
    for level, until in enumerate(depths):
        nodes = np.arange(before + 1, until + 1)
        if level:
            parent, char = keys[nodes - 1] >> _CHAR, keys[nodes - 1] & (1 << _CHAR) - 1
            fall[nodes] = _next(keys, fall, fall[parent], char)
        nearest[nodes] = np.where(mine[nodes], nodes, nearest[fall[nodes]])
        before = until
    cells = {
        "keys": pa.array(keys), "fall": pa.array(fall.astype(np.int32)), "nearest": pa.array(nearest.astype(np.int32)),
        "starts": pa.array(starts.astype(np.int32)), "order": pa.array(order.astype(np.int32)),
        "vendor_ord": pa.array([r[0] for r in rows], pa.int64()), "pat_ord": pa.array([r[1] for r in rows], pa.int64()),
        "vendor": pa.array([r[2] for r in rows], pa.string()), "pattern": pa.array([r[3] for r in rows], pa.string()),
        "loose": pa.array(loose, pa.bool_()), "depth": pa.array([len(depths)], pa.int64()),
    }
    batch = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells.values()], list(cells))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Automaton:
    """What `build` made, read in place."""

    def __init__(self, data: bytes):
        batch = pa.ipc.open_stream(data).read_next_batch()
        self.cells = {n: batch.column(n).values for n in batch.schema.names}
        self.keys, self.starts, self.order = (self.cells[n].to_numpy() for n in ("keys", "starts", "order"))
        self.fall, self.nearest = (self.cells[n].to_numpy() for n in ("fall", "nearest"))
        self.depth = self.cells["depth"][0].as_py()
        self.expressions: dict[int, re.Pattern | None] = {}

    def _occurs(self, i: int, text: str) -> bool:
        pattern = self.cells["pattern"][i].as_py()
        if not self.cells["loose"][i].as_py():
            return pattern in text
        if i not in self.expressions:
            try:
                self.expressions[i] = re.compile(pattern.replace("-", r"[\-\s]?"))
            except re.error:
                self.expressions[i] = None
        return self.expressions[i] is not None and self.expressions[i].search(text) is not None

    def _ends(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, state) wherever an anchor ends."""
        flat, ends = _codes([_SEPARATORS.sub("", t) for t in texts])
        lanes = -(-np.diff(ends) // LANE)
        row = np.repeat(np.arange(len(texts)), lanes)
        start = ends[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        size = np.minimum(LANE + self.depth - 1, ends[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        state = np.zeros(len(row), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            on = int(np.searchsorted(-size, -t))  # lanes that have a character here
            state = _next(self.keys, self.fall, state[:on], flat[start[:on] + t])
            at, where = self.nearest[state], row[:on]
            while len(at := at[keep := at > 0]):
                where = where[keep]
                yield where, at
                at = self.nearest[self.fall[at]]

    def first(self, texts: list[str | None]) -> list[int]:
        """The first pattern of the table that occurs in each text, -1 for none."""
        known = [t or "" for t in texts]
        found = list(self._ends(known))
        always = self.order[:self.starts[1]].tolist()  # patterns of the root
        cells = np.unique(np.concatenate([r * len(self.starts) + s for r, s in found])) if found else np.empty(0, np.int64)
        rows, states = np.divmod(cells, len(self.starts))
        cuts = np.searchsorted(rows, np.arange(len(texts) + 1)).tolist()
        out = []
        for i, text in enumerate(texts):
            chosen = -1
            if text is not None and (cuts[i] < cuts[i + 1] or always):
                some = [p for s in states[cuts[i]:cuts[i + 1]].tolist() for p in self.order[self.starts[s]:self.starts[s + 1]].tolist()]
                chosen = next((p for p in sorted(some + always) if self._occurs(p, text)), -1)
            out.append(chosen)
        return out

    def found(self, texts: pa.Array) -> pa.Array:
        """(vendor_ord, pat_ord, vendor) of the first pattern of each text, or null."""
        at = pa.array([None if i < 0 else i for i in self.first(texts.to_pylist())], pa.int64())
        names = ("vendor_ord", "pat_ord", "vendor")
        return pa.StructArray.from_arrays([self.cells[n].take(at) for n in names], list(names), mask=at.is_null())


def automata(patterns: DataFrame) -> list[Broadcast]:
    """Broadcast parts of a table (vendor_ord, pat_ord, vendor, pattern and optionally kind)."""
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in patterns.columns else F.lit("")
    last = F.lit((1 << 63) - 1)
    rows = patterns.filter(F.length("pattern") > 0).select(
        F.coalesce(F.col("vendor_ord").cast("long"), last).alias("vendor_ord"),
        F.coalesce(F.col("pat_ord").cast("long"), last).alias("pat_ord"),
        "vendor", "pattern", (kind == "phone_patterns").alias("phone"))
    # A text that several vendors share belongs to the first of them.
    rows = rows.groupBy("pattern", "phone").agg(F.min(F.struct("vendor_ord", "pat_ord", "vendor")).alias("r")).select(
        "pattern", "phone", "r.*")
    size = rows.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("vendor"), F.lit(0)) + 16)).first()[0] or 0
    parts = -(-size // PART_BYTES)

    def built(group: pa.Table) -> pa.Table:
        rows = zip(*(group.column(n).to_pylist() for n in ("vendor_ord", "pat_ord", "vendor", "pattern", "phone")))
        return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([build([
            (o, p, v or "", t, phone) for o, p, v, t, phone in rows])], pa.binary())})

    part = F.pmod(F.xxhash64("pattern"), F.lit(max(1, parts))).cast("int")
    made = materialize(rows.withColumn("part", part).groupBy("part").applyInArrow(built, "part INT, data BINARY"), "vendor-automata")
    context = patterns.sparkSession.sparkContext
    # One part at a time is on the driver.
    blobs = (made.filter(F.col("part") == i).select("data").first() for i in range(parts))
    return [context.broadcast(bytes(b[0])) for b in blobs if b is not None]


def _scan(text: Column, part: Broadcast) -> Column:
    @F.arrow_udf(f"struct<{_FOUND.replace(' BIGINT', ': bigint').replace(' STRING', ': string')}>")
    def scan(texts: pa.Array) -> pa.Array:
        return Automaton(part.value).found(texts)

    return scan(text)


def with_table_vendor(df: DataFrame, patterns: DataFrame, text: str = "raw_text", column: str = "vendor") -> DataFrame:
    """`df` with the vendor of the first pattern, by (vendor_ord, pat_ord), that occurs in each row's text; null if
    none does. Rows are judged one by one, whatever their ids."""
    parts = automata(patterns)
    none = F.lit(None).cast(f"struct<{_FOUND.replace(' BIGINT', ':bigint').replace(' STRING', ':string')}>")
    out = df.withColumn("_best", none)
    for i in range(0, len(parts), PARTS_AT_ONCE):
        if i:
            out = materialize(out, "vendor-matches")
        out = out.withColumn("_best", F.least(F.col("_best"), none, *[_scan(F.col(text), p) for p in parts[i:i + PARTS_AT_ONCE]]))
    return out.withColumn(column, F.col("_best.vendor")).drop("_best")
