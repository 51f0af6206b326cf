"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Method: the ranks are one literal of the plan, an array of small maps found by the CRC-32 of
a piece's bytes. A word starts as the array of its bytes, each with the rank of the pair that it
begins (a table of 65,536 entries, looked up for all bytes of a block at once); a
fold over its length merges the first pair of the lowest rank in each step and looks up the two
pairs that this changes. Decoding concatenates the binary pieces of the ids.

An element of the array is one number, of the rank of a part and its right neighbour, the part's
start and its end, so the smallest number is the pair to merge. The fold takes a time that grows with the
square of a word, so words of more than `LONG` bytes (none in running text) are merged in the task that
splits them, by a heap of their pairs: the same merges for a word of any length.

Only distinct words are encoded:

* Words between blanks and punctuation are counted over all texts, and the most frequent ones (`KEPT_WORDS` at
  most, each of `KEPT_BYTES` at most, so their size is bounded) are encoded once, gathered and
  broadcast.
* Tasks split their texts and number the words of some megabytes at a time. What the broadcast
  lacks is encoded in place, once for each such block. Nothing else is shuffled, no word is
  left out, and a lost task only repeats its own blocks.

Results by case: null text is encoded as the empty one, which has no ids and decodes to no
bytes; every other text decodes to its own bytes. Rows are independent: repeated rows and null
ids give a row each. A vocabulary must have all single bytes that occur.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.text import let
from .common import BLANKS, MARKS, Kept, Words, bounded, kept_by_worker, lean, relieve, stored, token_keys, uneven_rows

BUCKETS = 1 << 13
#: Bound of the broadcast: so many words, none of them longer.
KEPT_WORDS, KEPT_BYTES = 1 << 19, 48
#: Words that one task encodes of these, tokens that a worker remembers, and different words it counts.
TASK_WORDS, REMEMBERED, COUNTED = 1 << 16, 500_000, 300_000
#: Text that one block of words comes from, in characters; bytes of a word that the fold takes.
BLOCK_CHARS, LONG = 3 << 20, 256
#: Blocks in one file where they are stored.
FILE_BLOCKS = 16
#: Patterns (fixed values) that always split a text between a character and a blank after it, and
#: treat what follows in the same way whatever stood before, unless two blanks follow each other.
BLANK_PATTERNS = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
#: Bits of a start or an end; the rank above them that stands for none.
PLACE = 22
NONE = (1 << 63 - 2 * PLACE) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tables(ranks: dict[bytes, int]) -> Column:
    """Literal STRUCT of `ranks` (a map from a piece's digits to its rank for each bucket) and `pieces` (by id, null where the
    vocabulary has none)."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
        pieces[rank] = base64.b64encode(piece).decode()
    # Read from JSON alone, so that the optimizer makes a literal of it.
    parts = {"ranks": (buckets, "ARRAY<MAP<STRING, INT>>"), "pieces": (pieces, "ARRAY<BINARY>")}
    return F.struct(*[
        F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind).alias(name)
        for name, (value, kind) in parts.items()])


def _rank(table: Column, piece: Column) -> Column:
    return F.get(table, F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int"))[F.hex(piece)]


def _element(rank: Column, start: Column, end: Column) -> Column:
    return F.shiftleft(rank.cast("long"), 2 * PLACE) + F.shiftleft(start.cast("long"), PLACE) + end


def _start(element: Column) -> Column:
    return F.shiftright(element, PLACE).bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def _end(element: Column) -> Column:
    return element.bitwiseAND(F.lit((1 << PLACE) - 1).cast("long"))


def _bytes(word: Column, start: Column, end: Column) -> Column:
    return F.substring(word, (start + 1).cast("int"), (end - start).cast("int"))


def _merged(table: Column, word: Column, state: Column) -> Column:
    """The state after its best merge, if any pair has a rank.

    What only one element needs is written where that element is built, so it is computed once.
    """
    none = F.lit(NONE)

    def known(start: Column, end: Column) -> Column:
        return F.coalesce(_rank(table, _bytes(word, start, end)), none)

    def around(low: Column, i: Column) -> Column:
        # The best element swallows the next one; its rank and that of the one before are new.
        gone, after, before = F.get(state, i), F.get(state, i + 1), F.get(state, i - 2)
        own = _element(F.when(after.isNull(), none).otherwise(known(_start(low), _end(after))), _start(low), _end(gone))
        left = _element(known(_start(before), _end(gone)), _start(before), _start(low))
        return F.transform(F.array_remove(state, gone),
                           lambda e: F.when(e == low, own).when(e == before, left).otherwise(e))

    return let(F.array_min(state), lambda low: F.when(
        low >= F.lit(NONE << 2 * PLACE).cast("long"), state,
    ).otherwise(let(F.array_position(state, low).cast("int"), lambda i: around(low, i))))


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of every pair of bytes."""
    pairs = np.full(65_536, NONE, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            pairs[256 * piece[0] + piece[1]] = rank
    return pairs


def starts(words: list[bytes], pairs: np.ndarray) -> pa.ListArray:
    """The elements of each word's bytes, with the ranks of neighbouring ones."""
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32)
    rank = np.full(len(flat), NONE, np.int64)
    rank[:-1] = pairs[flat[:-1] * 256 + flat[1:]] if len(flat) > 1 else []
    rank[ends[1:] - 1] = NONE
    place = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rank << 2 * PLACE | place << PLACE | place + 1))


def encoded(table: Column, word: Column, start: Column) -> Column:
    """Ids (ARRAY<INT>) of one word (BINARY, not empty) from its elements; `table` is that of `tables`. A word that
    is no piece itself ends in two parts at least, so it has fewer merges than bytes by two."""
    ranks = table["ranks"]
    steps = F.when(F.length(word) > 2, F.sequence(F.lit(1), F.length(word) - 2)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, start, lambda state, _: _merged(ranks, word, state))
    return let(_rank(ranks, word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(
        F.transform(folded, lambda e: _rank(ranks, _bytes(word, _start(e), _end(e))))))


def decoded(pieces: Column, ids: Column) -> Column:
    """Bytes of an array of ids."""
    return F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, F.get(pieces, i)))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word. Pairs wait in a heap by rank and place; one that has changed since is passed
    over."""
    size = len(word)
    if word in ranks:
        return [ranks[word]]
    ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
    rank: list[int | None] = [None] * size

    def pair(i: int) -> int | None:
        return ranks.get(word[i:ends[ends[i]]]) if ends[i] < size else None

    heap = []
    for i in range(size - 1):
        rank[i] = ranks.get(word[i:i + 2])
        if rank[i] is not None:
            heap.append(rank[i] << 40 | i)
    heapq.heapify(heap)
    while heap:
        best = heapq.heappop(heap)
        i = best & (1 << 40) - 1
        if rank[i] != best >> 40:
            continue
        gone = ends[i]
        ends[i], rank[gone] = ends[gone], None
        if ends[i] < size:
            before[ends[i]] = i
        for at in (i, before[i]):
            if at >= 0:
                rank[at] = pair(at)
                if rank[at] is not None:
                    heapq.heappush(heap, rank[at] << 40 | at)
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return out


WORDS = "words ARRAY<BINARY>, starts ARRAY<ARRAY<LONG>>"


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`words` (WORDS) with `codes`: for each word its ids, as decimals joined by commas, their number,
    and the bytes that they decode to."""
    # The literal is some megabytes long: it need not be printed with every plan.
    words.sparkSession.conf.set("spark.sql.maxPlanStringLength", 100_000)

    def code(table: Column, word: Column, start: Column) -> Column:
        return let(encoded(table, word, start), lambda ids: F.struct(
            F.array_join(ids, ",").alias("ids"), F.size(ids).alias("size"), decoded(table["pieces"], ids).alias("bytes")))

    return words.withColumn("codes", let(tables(ranks), lambda t: F.transform(
        "words", lambda w, i: code(t, w, F.get("starts", i)))))


#: Blanks and the punctuation that most often follows a word separate what is counted.
_COUNTED = bytes(0x20 if chr(b) in " \t\n\r\x0b\x0c.,;:!?" else b for b in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters between blanks and punctuation, each with a blank before it, and how
    often they occur, leaving out what a task sees only once. This chooses the words that are worth
    keeping; what it misses is encoded in its block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, none = Words(_COUNTED), [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
        tally, held = none, bytearray()  # hash, count, and where the word lies among those held and ends

        def rows() -> pa.RecordBatch:
            _, counts, first, last = tally
            often = np.flatnonzero((counts > 1) & (last - first <= KEPT_BYTES))
            data = bytes(held)
            texts = [data[a:b] for a, b in zip(first[often].tolist(), last[often].tolist())]
            kept = [i for i, w in enumerate(texts) if w[1:].decode(errors="replace").isalpha()]
            return pa.RecordBatch.from_arrays(
                [pa.array([texts[i] for i in kept], pa.binary()), pa.array(counts[often[kept]])], ["word", "n"])

        for batch in batches:
            for _, chunk in words.chunks(batch.column(0)):
                kinds = pa.array(chunk.hashes).dictionary_encode()
                number, hashes = kinds.indices.to_numpy(), kinds.dictionary.to_numpy()
                first, order = np.empty(len(hashes), np.int64), np.argsort(hashes)
                first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
                hashes, first, found = hashes[order], first[order], np.bincount(number, minlength=len(hashes))[order]
                at = np.minimum(np.searchsorted(tally[0], hashes), max(0, len(tally[0]) - 1))
                same = tally[0][at] == hashes if len(tally[0]) else np.zeros(len(hashes), bool)
                tally[1][at[same]] += found[same]
                new = ~same
                data, ends = chunk.spaced(first[new])
                place = np.searchsorted(tally[0], hashes[new])
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                tally = [np.insert(old, place, own) for old, own in zip(
                    tally, (hashes[new], found[new], starts + len(held), ends + len(held)))]
                held += data
                if len(tally[0]) > COUNTED:
                    yield rows()
                    tally, held = none, bytearray()
        yield rows()

    counts = bounded(docs).select("text").mapInArrow(count, "word BINARY, n LONG")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(docs: DataFrame, ranks: dict[bytes, int]) -> pa.Table:
    """(word, ids, size, bytes) of the most frequent words, at most KEPT_WORDS, the first ones first."""
    counts = stored(_counted(docs), "word-counts")
    # As many rows as there are different counts; their sum over the words bounds them by its root.
    left, least = KEPT_WORDS, None
    for n, words in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if words > left:
            break
        left, least = left - words, n
    chosen = counts.filter(F.col("n") >= least) if least else counts.limit(0)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        pairs = byte_pairs(ranks)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, batch.column(0)), pa.ListArray.from_arrays(ends, starts(words, pairs)),
                 batch.column(1)], ["words", "starts", "n"])

    spread = chosen.select("word", "n").repartition(max(1, (KEPT_WORDS - left) // TASK_WORDS))
    rows = encode_words(spread.mapInArrow(prepare, WORDS + ", n LONG"), ranks)
    # An outer explode: for the plain one, codes would be computed once more to filter by their number.
    out = rows.select("n", F.col("words")[0].cast("string").alias("word"), F.explode_outer("codes").alias("c")).select(
        "n", "word", F.col("c.ids").cast("binary").alias("ids"), "c.size", "c.bytes").toArrow()
    return out.sort_by([("n", "descending")]).drop_columns("n")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Numbers:
    """Words of texts by number: the place among the known words, or behind those a number of the
    worker's own. Tokens between blanks are looked up by their hashes, whole chunks at once."""

    def __init__(self, find, by_blanks: bool, known: pa.Array):
        import xxhash

        self.hashes = lambda words: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.find, self.by_blanks, self.known = find, by_blanks, known
        self.words = Words(BLANKS, second=True, seed=None, marks=MARKS if by_blanks else b"")
        every = self.hashes(known.to_pylist())
        self.order = np.argsort(every)
        self.every = every[self.order]
        self.clear()

    def clear(self) -> None:
        self.kept = Kept(np.dtype(np.int32))
        self.own: list[bytes] = []
        self.marks = np.full(256, -1, np.int32)
        if self.by_blanks:
            self.marks[list(MARKS)] = self.places([chr(m) for m in MARKS])

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each of some different words."""
        out = np.full(len(words), -1, np.int32)
        if words and len(self.every):
            mine = self.hashes(words)
            at = np.minimum(np.searchsorted(self.every, mine), len(self.every) - 1)
            hits = np.flatnonzero(self.every[at] == mine)
            out[hits] = self.order[at[hits]]
            for i, w in zip(hits.tolist(), self.known.take(pa.array(out[hits])).to_pylist()):
                if w != words[i]:  # two words of one hash
                    out[i] = -1
        new = np.flatnonzero(out < 0)
        out[new] = len(self.known) + len(self.own) + np.arange(len(new))
        self.own.extend(words[i].encode() for i in new.tolist())
        return out

    def of_words(self, lists: list[list[str]]) -> np.ndarray:
        """Numbers of the words of all lists in a row."""
        different = list(dict.fromkeys(w for words in lists for w in words))
        place = dict(zip(different, self.places(different).tolist()))
        return np.array([place[w] for words in lists for w in words], np.int32)

    def rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The numbers of the words of each text."""
        for first, chunk in self.words.chunks(texts):
            alone = uneven_rows(chunk, []) if self.by_blanks else np.diff(chunk.ends) > 0
            hashes, checks, head = token_keys(chunk)
            skipped = np.repeat(alone, np.diff(chunk.bounds))
            place, size = self.kept.find(hashes, checks)
            missing = np.flatnonzero((size < 0) & ~skipped)
            while len(missing):  # again for tokens of one hash that differ in their check
                _, once = np.unique(hashes[missing], return_index=True)
                once = missing[once]
                tokens = chunk.spaced(once)[0].decode().split(" ")[1:]
                lists = [self.find(t) if h else [" " + t] if t.isalpha() else self.find(" " + t)
                         for t, h in zip(tokens, head[once].tolist())]
                self.kept.add(hashes[once], checks[once], self.of_words(lists), np.array([len(ws) for ws in lists], np.int64))
                place[missing], size[missing] = self.kept.find(hashes[missing], checks[missing])
                missing = missing[size[missing] < 0]
            size[skipped] = 0
            marks = None if chunk.tail is None else np.where(skipped, np.int32(-1), self.marks[chunk.tail])
            flat, stops = self.kept.gather(place, size, marks)
            ends = np.r_[0, stops][chunk.bounds]
            for row in range(len(chunk)):
                if alone[row]:
                    yield self.of_words([self.find(texts[first + row].as_py())])
                else:
                    yield flat[ends[row]:ends[row + 1]]

    def block(self, rows: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, list[bytes], list[bytes]]:
        """(numbers of each text within the block, packed; for each word of the block its place among the
        known ones, -1 for others and -2 for long ones; the words of the last two)."""
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        count = len(self.known)
        here = np.zeros(count + len(self.own), bool)
        here[flat] = True
        used = np.flatnonzero(here)
        number = np.empty(len(here), np.int32)
        number[used] = np.arange(len(used))
        cells = np.split(number[flat], np.cumsum([len(r) for r in rows])[:-1])
        new = [self.own[i] for i in (used[used >= count] - count).tolist()]
        tail = np.where(used < count, used, -1).astype(np.int32)
        tail[used >= count] -= np.array([len(w) > LONG for w in new], np.int32)
        return [c.tobytes() for c in cells], tail, [w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]


#: What is known of a word: its ids as decimals joined by commas, their number, and the bytes that they decode to.
_CODE = pa.struct([("ids", pa.binary()), ("size", pa.int32()), ("bytes", pa.binary())])


def _joined(cells: pa.Array, ids: pa.Array, size: np.ndarray, pieces: pa.Array):
    """(number of ids, ids joined by commas, bytes) of each text, from the packed numbers of its words and what
    is known of these words. All words of a block are taken at once."""
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1] // 4
    data = cells.buffers()[2]
    at = np.frombuffer(data, np.int32)[ends[0]:ends[-1]] if data is not None and data.size else np.empty(0, np.int32)
    ends = (ends - ends[0]).tolist()
    places = pa.array(at)
    total = np.r_[0, np.cumsum(size[at], dtype=np.int64)][ends].tolist()
    views = []
    for column in (ids, pieces):
        taken = column.take(places)
        edges = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1]
        views.append((edges[ends].tolist(), memoryview(taken.buffers()[2] or b"")))
    (first, codes), (start, text) = views
    for i in range(len(ends) - 1):
        # Behind each id of a word stands a comma, the last one of which goes.
        yield total[i + 1] - total[i], codes[first[i]:max(first[i], first[i + 1] - 1)], text[start[i]:start[i + 1]]


def _split(pattern: str, known, ranks: dict[bytes, int], batches: Iterator[pa.RecordBatch], size: int,
           remembered: int) -> Iterator[pa.RecordBatch]:
    """Blocks: ids of documents, their words as numbers, and for the words of the block (`tail`) their
    places among the known ones, -1 for the next of the `words` to encode, or -2 for the next of the `ready`
    ones."""
    import regex
    import xxhash

    numbers = kept_by_worker("bpe", (xxhash.xxh3_64_intdigest(known.value), pattern), lambda: _Numbers(
        regex.compile(pattern).findall, pattern in BLANK_PATTERNS, _unpacked(known.value).column("word").combine_chunks()))
    ids, rows, chars, pairs = [], [], 0, byte_pairs(ranks)
    pieces = {rank: piece for piece, rank in ranks.items()}

    def block() -> pa.RecordBatch:
        cells, tail, new, long = numbers.block(rows)
        # Long words are decoded from their ids too, as all others are.
        ready = [{"ids": ",".join(map(str, codes)).encode(), "size": len(codes), "bytes": b"".join(map(pieces.get, codes))}
                 for codes in (merged(w, ranks) for w in long)]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([cells], pa.list_(pa.binary())),
             pa.array([tail], pa.list_(pa.int32())), pa.array([ready], pa.list_(_CODE)), pa.array([new], pa.list_(pa.binary())),
             pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), starts(new, pairs))],
            ["ids", "cells", "tail", "ready", "words", "starts"])

    for batch in batches:
        if len(numbers.kept) > remembered:
            if rows:
                yield block()  # its numbers are about to be forgotten
                ids, rows, chars = [], [], 0
            numbers.clear()
        for doc, words in zip(batch.column(0).to_pylist(), numbers.rows(batch.column(1))):
            ids.append(doc)
            rows.append(words)
            chars += len(words) * 5  # a word has some five characters
            if chars >= size:
                yield block()
                ids, rows, chars = [], [], 0
    if ids:
        yield block()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, schema: pa.Schema, block: int = BLOCK_CHARS,
           remembered: int = REMEMBERED, apart: bool = False) -> DataFrame:
    """`finish(doc_id, number of ids, ids, bytes)` -> a row of `schema` for each document; the ids are decimals
    joined by commas, as bytes. Smaller blocks and fewer remembered tokens take less memory and more time, and so
    does storing the encoded blocks (`apart`): a task then has one Python worker instead of two."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent, context = _frequent(own, ranks), docs.sparkSession.sparkContext
    known, codes = (context.broadcast(_packed(frequent.select(names))) for names in (["word"], ["ids", "size", "bytes"]))
    relieve(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from _split(pattern, known, ranks, batches, block, remembered)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        kept = _unpacked(codes.value)
        kept = [kept.column(n).combine_chunks() for n in ("ids", "size", "bytes")]
        for batch in batches:
            for row in range(batch.num_rows):
                tail = batch.column("tail")[row].values.to_numpy()
                new, ready = batch.column("codes")[row].values, batch.column("ready")[row].values
                # Codes of the block's words: those of known words, then the new ones, then the long ones.
                order = np.argsort(np.where(tail < 0, -tail, 0), kind="stable")
                place = np.empty(len(tail), np.int64)
                place[order] = np.arange(len(tail))
                mine = pa.array(tail[tail >= 0])
                ids, size, pieces = (
                    pa.concat_arrays([kept[i].take(mine), new.field(n).cast(kept[i].type), ready.field(n).cast(kept[i].type)]).take(pa.array(place))
                    for i, n in enumerate(("ids", "size", "bytes")))
                marked = pc.binary_join_element_wise(ids.cast(pa.large_binary()), pa.scalar(b",", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                found = _joined(batch.column("cells")[row].values, marked, size.to_numpy(), pieces.cast(pa.large_binary()))
                docs = batch.column("ids")[row].as_py()
                yield pa.RecordBatch.from_pylist([finish(doc, *f) for doc, f in zip(docs, found)], schema)

    blocks = bounded(own).mapInArrow(split, "ids ARRAY<LONG>, cells ARRAY<BINARY>, tail ARRAY<INT>, "
                                     "ready ARRAY<STRUCT<ids: BINARY, size: INT, bytes: BINARY>>, " + WORDS)
    coded = encode_words(blocks, ranks).select("ids", "cells", "tail", "ready", "codes")
    if apart:
        coded = stored(coded, "coded-blocks", FILE_BLOCKS)
    return coded.mapInArrow(join, from_arrow_schema(schema))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document (doc_id, text)."""

    def finish(doc, n_tokens, ids, pieces):
        return {"doc_id": doc, "n_tokens": n_tokens,
                "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(pieces).hexdigest()}

    return encode(docs, ranks, pattern, finish, pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), **options)


def token_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids ARRAY<INT>, decoded BINARY) for every document."""

    def finish(doc, n_tokens, ids, pieces):
        return {"doc_id": doc, "ids": [int(x) for x in bytes(ids).split(b",") if x], "decoded": bytes(pieces)}

    return encode(docs, ranks, pattern, finish, pa.schema([
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))
