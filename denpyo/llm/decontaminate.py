"""Benchmark decontamination: word windows of benchmark items found in documents.

Method: broadcast hash set. The items' word windows are hashed; every task slides over the words
of its documents, looks window hashes up in the set and verifies a hit on the words
themselves. No shuffle, and a document is read once however long it is.

The set is broadcast in parts of at most `PART_WINDOWS` windows and `PART_BYTES` of text, sorted by hash in one Arrow
buffer, which a worker reads in place. So its size is bounded whatever the benchmark's; with more parts
the documents are stored once with a key for each row, scanned part by part, and the hits of all parts are joined by
that key before anything is judged or cut. Hits are spans of words; the items that share a window are named once
for each row, not for each occurrence. So the results do not depend on the number of parts, whatever
the ids.

A word is a run of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. An item
with fewer words than a window, but at least one, is one window of its own length.

Results by case: null or wordless text has no words and no hit; items with null id, null text or
no words are ignored; repeated items count once; equal windows of several items hit all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded, kept_by_worker, lean, sent, stored, strings, windows
from .common import keyed as keyed_rows

WINDOW = 13
PART_WINDOWS, PART_BYTES = 1 << 19, 32 << 20
SPANS = "spans ARRAY<STRUCT<first: INT, last: INT>>, items ARRAY<STRING>"
RESULT = "doc_id LONG, n_words LONG, n_hit LONG, n_items LONG, items_sha256 STRING, contaminated BOOLEAN"
#: Bytes that words consist of, upper case already lowered; all others separate words.
_WORD_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, length, hash, words) of all windows of the items (item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words = Words(_WORD_BYTES)
        for batch in batches:
            rows, items = [], batch.column(0).to_pylist()
            for first, chunk in words.chunks(batch.column(1)):
                for r, hashes in enumerate(chunk.shingles(size)):
                    a, b = int(chunk.bounds[r]), int(chunk.bounds[r + 1])
                    length = min(size, b - a)
                    if items[first + r] is None or not length:
                        continue
                    for i, h in enumerate(hashes.view(np.int64).tolist()):
                        rows.append((items[first + r], length, h, b" ".join(map(chunk.word, range(a + i, a + i + length)))))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                ["item_id", "length", "hash", "words"])

    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(cut, "item_id STRING, length INT, hash LONG, words BINARY").distinct()
    )


class Scanner:
    """The windows of one part, ready to look words up in. `rows` (item_id, length, hash, words) are sorted by length,
    hash and words."""

    def __init__(self, rows: pa.Table):
        self.items, self.words = (rows.column(n).combine_chunks() for n in ("item_id", "words"))
        length, hashes = rows.column("length").to_numpy(), rows.column("hash").to_numpy()
        new = np.ones(len(length), bool)
        if len(new) > 1:
            words = rows.column("words").combine_chunks()
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            new[1:] |= (hashes[1:] != hashes[:-1]) | (length[1:] != length[:-1])
        # A window is the rows of equal words: the places where each starts, and behind the last.
        self.starts = np.r_[np.flatnonzero(new), len(new)]
        first = self.starts[:-1]
        self.known = {int(n): (hashes[first[length[first] == n]], int(np.flatnonzero(length[first] == n)[0])) for n in np.unique(length)}

    def named(self, found: set[int]) -> set[str]:
        """The items of some windows."""
        return {i for w in found for i in self.items[int(self.starts[w]):int(self.starts[w + 1])].to_pylist()}

    def hits(self, chunk) -> list[list[tuple[int, int, int]]]:
        """For each row of a chunk (first word, last word, window) of every occurrence."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(chunk))]
        for length, (known, base) in self.known.items():
            if len(chunk.hashes) < length:
                continue
            mine = windows(chunk.hashes, length).view(np.int64)
            at = np.searchsorted(known, mine)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == mine).tolist():
                row = int(np.searchsorted(chunk.bounds, i, side="right")) - 1
                if i + length > chunk.bounds[row + 1]:
                    continue  # goes beyond its text
                text, place = b" ".join(map(chunk.word, range(i, i + length))), int(at[i])
                while place < len(known) and known[place] == mine[i]:  # more than one for equal hashes only
                    if self.words[int(self.starts[base + place])].as_py() == text:
                        first = i - int(chunk.bounds[row])
                        out[row].append((first, first + length - 1, base + place))
                    place += 1
        return out


def _parts(items: DataFrame, size: int) -> list:
    """Broadcasts of the windows, each of at most some PART_WINDOWS of them and PART_BYTES."""
    bounded(items)
    cut = stored(item_windows(items, size), "benchmark-windows")
    count, text = cut.agg(F.count("*"), F.sum(F.octet_length("words") + F.octet_length("item_id"))).first()
    parts = max(1, -(-count // PART_WINDOWS), -(-(text or 0) // PART_BYTES))
    spark = items.sparkSession
    for part in range(parts):
        mine = cut if parts == 1 else cut.filter(F.pmod(F.hash("words"), F.lit(parts)) == part)
        rows = mine.toArrow().sort_by([("length", "ascending"), ("hash", "ascending"), ("words", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        yield spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    hit, end = 0, -1
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end + 1) + 1)
        end = max(end, b)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, hit, len(items), digest, hit > 0 and 20 * hit >= n_words


def _scan(batches: Iterator[pa.RecordBatch], part, text_at: int):
    """(batch, [(n_words, [(first, last, window)])], scanner) for each batch."""
    data = part.value
    scanner, words = kept_by_worker("scanner", xxhash.xxh3_128_intdigest(data), lambda: (
        Scanner(pa.ipc.open_stream(data).read_all()), Words(_WORD_BYTES)))
    for batch in batches:
        found = []
        for _, chunk in words.chunks(batch.column(text_at)):
            found.extend(zip(np.diff(chunk.bounds).tolist(), scanner.hits(chunk)))
        yield batch, found, scanner


def _spans(keyed: DataFrame, parts: list) -> DataFrame:
    """(row_key, doc_id, n_words, spans, items) of each row of documents whose last column is a key, with the hits of
    all parts."""
    own = keyed.select(F.col(keyed.columns[-1]).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    place = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    out = None
    for part in parts:
        def spans(batches: Iterator[pa.RecordBatch], part=part, first=out is None) -> Iterator[pa.RecordBatch]:
            lean()
            for batch, found, scanner in _scan(batches, part, 2):
                cells = [[{"first": a, "last": b} for a, b in sorted({(a, b) for a, b, _ in hits})] for _, hits in found]
                names = [sorted(scanner.named({w for *_, w in hits})) for _, hits in found]
                rows = pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()),
                     pa.array(cells, place), pa.array(names, pa.list_(pa.string()))],
                    ["row_key", "doc_id", "n_words", "spans", "items"])
                # The first part has every row, the others those with hits.
                yield rows if first else rows.filter(pa.array([bool(c) for c in cells], pa.bool_()))

        one = own.mapInArrow(spans, f"row_key LONG, doc_id LONG, n_words LONG, {SPANS}")
        out = one if out is None else out.union(one)
    if len(parts) == 1:
        return out
    return out.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def find_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items): the places of every window of an item, and the items found, one row for each
    of docs."""
    parts = list(_parts(items, size))
    keyed = keyed_rows(docs.select("doc_id", "text"))[0] if len(parts) > 1 else docs.withColumn("row_key", F.lit(0).cast("long"))
    return _spans(keyed, parts).select("doc_id", "n_words", "spans", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found and the verdict (see RESULT).

    Contaminated: a twentieth of the words or more are hit.
    """
    parts = list(_parts(items, size))
    if len(parts) > 1:
        return _judged(keyed_rows(docs.select("doc_id", "text"))[0], parts).drop("row_key")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch, found, scanner in _scan(batches, parts[0], 1):
            yield _results(batch.columns[:1], [
                _verdict(n, [(a, b) for a, b, _ in hits], scanner.named({w for *_, w in hits}))
                for n, hits in found])

    return own.mapInArrow(judge, RESULT)


def _results(ids: list[pa.Array], results: list[tuple]) -> pa.RecordBatch:
    """The ids' columns and the verdicts, as RESULT has them."""
    cols = list(zip(*results)) if results else [()] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = ["row_key"][:len(ids) - 1] + ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays(ids + [pa.array(c, t) for c, t in zip(cols, types)], names)


def _judged(keyed: DataFrame, parts: list) -> DataFrame:
    """row_key and RESULT for each row, from the hits of all parts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            yield _results(batch.columns[:2], [
                _verdict(n, [(s["first"], s["last"]) for s in spans], set(names))
                for n, spans, names in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))])

    return _spans(keyed, parts).mapInArrow(merge, "row_key LONG, " + RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", size: int = WINDOW) -> DataFrame:
    """The documents with all their columns, without what the benchmark has.

    `remove`: "documents" drops contaminated ones; "spans" cuts the hit words, and what stands
    between them, out of every document. Texts without a hit stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    at = docs.columns.index("text")
    parts = list(_parts(items, size))
    if len(parts) > 1:
        return _decontaminated(docs, parts, remove)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch, found, scanner in _scan(batches, parts[0], at):
            if remove == "documents":
                keep = [not _verdict(n, [(a, b) for a, b, _ in hits], set())[-1] for n, hits in found]
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield _cut(batch, at, [[(a, b) for a, b, _ in hits] for _, hits in found])

    return docs.mapInArrow(clean, docs.schema)


def _decontaminated(docs: DataFrame, parts: list, remove: str) -> DataFrame:
    """The documents without what the parts together have."""
    keyed, key = keyed_rows(docs)
    names = docs.columns
    at, columns = names.index("text"), [f"`{c}`" for c in names]
    if remove == "documents":
        bad = _judged(keyed, parts).filter("contaminated").select(F.col("row_key").alias(key))
        return keyed.join(sent(bad), key, "left_anti").select(*columns)
    hit = stored(_spans(keyed, parts).filter(F.size("spans") > 0).select(
        F.col("row_key").alias(key), F.array_distinct("spans").alias("cuts")), "benchmark-cuts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            spans = [[(s["first"], s["last"]) for s in cuts] for cuts in batch.column(batch.num_columns - 1).to_pylist()]
            yield _cut(batch.select(names), at, spans)

    whole = keyed.join(sent(hit.select(key)), key, "left_anti").select(*columns)
    return whole.unionByName(keyed.join(hit, key).select(*columns, "cuts").mapInArrow(clean, docs.schema))


def _cut(batch: pa.RecordBatch, at: int, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch with the spans cut out of the text in column `at`."""
    cols = list(batch.columns)
    cols[at] = pa.array([_without(t, own) if own else t for t, own in zip(strings(batch.column(at)), spans)], pa.string())
    return pa.RecordBatch.from_arrays(cols, batch.schema.names)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    kind = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, kind, False]))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in sorted(spans):
        if ends[b] > at:
            out.append(raw[at:max(at, starts[a])])
            at = ends[b]
    return b"".join(out + [raw[at:]]).decode()
