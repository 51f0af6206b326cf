"""Helpers shared by the operators: stored stages, word hashes, shingle sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_dir

#: Odd 64-bit constants of well-known hash mixers.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: Text that is hashed at once, in bytes.
CHUNK = 1 << 18


#: Seconds without a task after which a worker gives up what it has kept.
FORGET = 1.0


def _space() -> dict:
    import sys
    import types

    return sys.modules.setdefault("denpyo_worker", types.ModuleType("denpyo_worker")).__dict__.setdefault("kept", {})


def _give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """Give back what the driver no longer needs: Python's objects first, as they keep plans alive in the JVM, then the
    JVM's, which lets Spark drop the broadcasts and shuffles of these plans and returns heap to the system."""
    _give_back()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def _watch() -> None:
    """Wait for a time without a task, then forget everything. Python workers live on beside each other for a
    minute and share an executor's memory with those of the next stage."""
    import time

    from pyspark import TaskContext

    idle = 0.0
    while idle < FORGET:
        time.sleep(0.2)
        idle = idle + 0.2 if TaskContext.get() is None else 0.0
        if 0.1 < idle < 0.3:
            _give_back()  # what the task has freed
    _space().clear()  # and with it the mark that this thread runs
    _give_back()


def lean() -> None:
    """At the start of a task: Arrow gives freed memory back at once, and a thread sees to it that nothing
    is held when the worker has nothing to do."""
    import threading

    pa.set_memory_pool(pa.system_memory_pool())
    _give_back()
    space = _space()
    if "watched" not in space:
        space["watched"] = (None, None)
        threading.Thread(target=_watch, daemon=True).start()


def kept_by_worker(name: str, key, build):
    """What `build` gave for this key in this Python worker, one thing for each name. It outlives the
    task, as a module's state would; tasks may run in any worker and any order, so it only ever
    saves time."""
    space = _space()
    if space.get(name, (None,))[0] != key:
        space.pop(name, None)
        space[name] = (key, build())
    return space[name][1]


#: Beyond Latin letters and common punctuation, versions of Unicode may class a character differently.
FOREIGN = re.compile("[^\u0000-\u024f\u2010-\u203a\u20ac]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches hold so many bytes at most, whatever the length of the texts.
BATCH_BYTES = 2 << 20


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, in a session whose Arrow batches are bounded."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def stored(df: DataFrame, purpose: str, file_rows: int = 0) -> DataFrame:
    """The rows, written to the shared folder and read back: what follows starts from files
    that survive lost executors. Large rows need files of few (`file_rows`), as readers take some thousand at once."""
    bounded(df)
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most, and bytes of their texts; more are joined by a shuffle.
IDS_SENT, BYTES_SENT = 500_000, 16 << 20


def sent(rows: DataFrame, stored_already: bool = False) -> DataFrame:
    """Narrow rows, to be broadcast if a count shows that they are few and small enough."""
    rows = rows if stored_already else stored(rows, "ids")
    texts = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)).cast("long") for n, kind in rows.dtypes if kind in ("string", "binary")]
    count, size = rows.agg(F.count("*"), F.sum(sum(texts, F.lit(0).cast("long")))).first()
    return F.broadcast(rows) if count <= IDS_SENT and (size or 0) <= BYTES_SENT else rows


def _sent(ids: DataFrame) -> DataFrame:
    return sent(ids.filter("doc_id IS NOT NULL").distinct())


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, stored with a key of their own, and the name of the key's column."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def without_rows(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of `keyed`, without those of the given keys and without the key."""
    return rows.join(sent(gone), key, "left_anti").select(*[f"`{c}`" for c in rows.columns if c != key])


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ids (doc_id), with their columns; null ids stay."""
    return docs.join(_sent(ids), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(_sent(ids), "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def hash_sample(rows: DataFrame, size: int) -> DataFrame:
    """About `size` of the rows, or all if there are no more: those of the smallest hashes of
    their doc_id, by a limit that the row count gives."""
    count = rows.count()
    if count <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(size / count * (1 << 30))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(29))


#: The two largest primes below 2^31.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Bytes whose products with powers (256 x 2^31 at most) add up within 64 bits.
SUMMED = 1 << 24


def _powers(count: int, base: int, prime: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime."""
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        more = min(done, count - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


_LETTERS = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
#: Second bytes of the letters U+00C0 to U+00FF, without the signs for times and divided by.
_AFTER_C3 = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


class Words:
    """64-bit hashes of the words of whole columns of text.

    `fold` maps each byte of UTF-8 to the byte it counts as; 0x20 separates words. A hash joins
    two polynomials of the word's bytes, modulo two primes and at a random base each, taken
    from running sums over all bytes: the same word has the same hash wherever it stands, and two words
    agree in both polynomials with a probability of some 2^-60.
    """

    def __init__(self, fold: bytes, second: bool = False, seed: int | None = 20_240_501, marks: bytes = b""):
        """`second`: words get another check, of their length and first eight bytes. Hashes of one `seed`
        agree between tasks; None draws bases that nobody knows in advance. One of the `marks` behind a letter
        at the end of a word is set apart."""
        self.marks = np.isin(np.arange(256), list(marks))
        self.fold = np.frombuffer(fold, np.uint8)
        self.value = self.fold.astype(np.uint64) + np.uint64(1)
        rng = np.random.default_rng(seed)
        self.bases = [int(rng.integers(1 << 20, p - 1)) for p in PRIMES]
        self.checked = second
        self._grow(CHUNK)

    def _grow(self, size: int) -> None:
        self.size = size
        self.tables = [(np.uint64(p), _powers(size, b, p), _powers(size, pow(b, -1, p), p).astype(np.uint32))
                       for p, b in zip(PRIMES, self.bases)]

    def chunks(self, texts: pa.Array, size: int = CHUNK):
        """(first row, Chunk) for runs of rows of about `size` bytes; null texts have no words."""
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else [0]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
            yield row, Chunk(self, data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row])
            row = stop


class Chunk:
    """Words of some rows: `hashes` of all of them, `bounds` of each row among them."""

    def __init__(self, words: Words, raw: np.ndarray, ends: np.ndarray):
        if len(raw) > words.size:
            words._grow(len(raw))
        inside = words.fold[raw] != 0x20
        self.raw, self.ends, self.fold = raw, ends, words.fold
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True  # a word ends with its row
        opens, closes = inside.copy(), inside.copy()
        if len(raw) > 1:
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.tail = self._tails(words) if words.marks.any() else None
        self.hashes = self._hashed(words, words.value[raw])
        self.second = self._check() if words.checked else None
        self.bounds = np.searchsorted(self.starts, ends)

    def _hashed(self, words: Words, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        for prime, power, inverse in words.tables:
            terms, sums = value * power[:len(value)], np.zeros(len(value) + 1, np.uint64)
            for at in range(0, len(terms), SUMMED):
                np.cumsum(terms[at:at + SUMMED], out=sums[at + 1:at + SUMMED + 1])
                if at:
                    sums[at + 1:at + SUMMED + 1] += sums[at] % prime
            word = sums[self.stops] % prime + prime - sums[self.starts] % prime if len(terms) > SUMMED \
                else sums[self.stops] - sums[self.starts]
            out = out << np.uint64(31) | word % prime * inverse[self.starts] % prime
        return mixed(out)

    def _tails(self, words: Words) -> np.ndarray:
        """The mark that was taken from the end of each word, 0 for none: one behind a letter, of ASCII or of
        two bytes between U+00C0 and U+00FF."""
        out, raw = np.zeros(len(self.starts), np.uint8), self.raw
        at = np.flatnonzero(words.marks[raw[self.stops - 1]] & (self.stops - self.starts > 1))
        last = raw[self.stops[at] - 2]
        letter = _LETTERS[last] | ((raw[np.maximum(self.stops[at] - 3, 0)] == 0xC3) & _AFTER_C3[last] & (self.stops[at] - self.starts[at] > 2))
        at = at[letter]
        out[at] = raw[self.stops[at] - 1]
        self.stops[at] -= 1
        return out

    def _check(self) -> np.ndarray:
        """Length and first eight bytes (as they stand in the text) of each word, in one number: words of
        one hash differ in it unless they also agree in both."""
        padded = np.r_[self.raw, np.zeros(8, np.uint8)]
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))[self.starts]
        size = (self.stops - self.starts).astype(np.uint64)
        kept = np.minimum(size, np.uint64(8)) * np.uint64(8)
        mask = np.where(kept == 64, ~np.uint64(0), (np.uint64(1) << (kept % np.uint64(64))) - np.uint64(1))
        return (eight & mask) * MIX[0] + size * MIX[1]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> bytes:
        return self.fold[self.raw[self.starts[i]:self.stops[i]]].tobytes()

    def spaced(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(some words in a row, each behind a blank; where each ends)."""
        size = self.stops[at] - self.starts[at] + 1
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        inner = np.ones(len(out), bool)
        inner[ends - size] = False
        out[inner] = self.raw[np.repeat(self.starts[at] - np.cumsum(size - 1) + size - 1, size - 1) + np.arange(int((size - 1).sum()))]
        return out.tobytes(), ends

    def shingles(self, size: int):
        """The window hashes of each row in order; a row of fewer words is one window."""
        every = windows(self.hashes, size) if len(self.hashes) >= size else None
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            yield every[a:b - size + 1] if b - a >= size else windows(self.hashes[a:b], b - a) if b > a else _NONE


_NONE = np.empty(0, np.uint64)
#: Words between blanks, and words between ASCII white space with A-Z lower-cased.
BLANKS = bytes(range(256))
SPACED = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Part:
    """Rows (hash, check, place and count of the numbers), sorted by hash. The leading bits of a hash lead to
    its neighbourhood, which has one row on average."""

    def __init__(self):
        self.rows = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32)]

    def __len__(self) -> int:
        return len(self.rows[0])

    def merge(self, rows: list[np.ndarray]) -> None:
        at = np.searchsorted(self.rows[0], rows[0])
        self.rows = [np.insert(old, at, new) for old, new in zip(self.rows, rows)]
        bits = max(1, len(self).bit_length())
        self.shift = np.uint64(64 - bits)
        sizes = np.bincount((self.rows[0] >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.r_[0, np.cumsum(sizes)].astype(np.int32)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The row of each pair, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return out
        near = (hashes >> self.shift).astype(np.int64)
        at, stop = self.first[near], self.first[near + 1]
        left = np.flatnonzero(at < stop)
        at, stop, hashes, checks = at[left], stop[left], hashes[left], checks[left]
        while len(left):
            same = (self.rows[0][at] == hashes) & (self.rows[1][at] == checks)
            out[left[same]] = at[same]
            more = ~same & (at + 1 < stop)
            left, at, stop, hashes, checks = left[more], at[more] + 1, stop[more], hashes[more], checks[more]
        return out


class Kept:
    """Numbers (a few for each token) by the token's hash and check, in arrays: a large sorted part and a
    small recent one."""

    RECENT = 1 << 17

    def __init__(self, dtype: np.dtype):
        self.numbers = np.empty(1 << 18, dtype)
        self.used = 0
        self.parts = [_Part(), _Part()]

    def add(self, hashes: np.ndarray, checks: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(codes) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.empty_like(self.numbers)])
        self.numbers[self.used:self.used + len(codes)] = codes
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(codes)
        order = np.argsort(hashes, kind="stable")
        self.parts[1].merge([hashes[order], checks[order], places[order], sizes[order].astype(np.int32)])
        if len(self.parts[1]) > self.RECENT:
            self.parts[0].merge(self.parts[1].rows)
            self.parts[1] = _Part()

    def __len__(self) -> int:
        return len(self.parts[0]) + len(self.parts[1])

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of the numbers of each token; count -1 for unknown ones."""
        place, size = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        rows = self.parts[0].find(hashes, checks)
        found = np.flatnonzero(rows >= 0)
        if len(found):
            place[found], size[found] = self.parts[0].rows[2][rows[found]], self.parts[0].rows[3][rows[found]]
        left = np.flatnonzero(rows < 0)
        if len(left) and len(self.parts[1]):
            rows = self.parts[1].find(hashes[left], checks[left])
            left, rows = left[rows >= 0], rows[rows >= 0]
            place[left], size[left] = self.parts[1].rows[2][rows], self.parts[1].rows[3][rows]
        return place, size

    def gather(self, place: np.ndarray, size: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens in a row, where each token's end). `marks` has for some tokens, else -1, one more
        number that stands behind their own."""
        stops = np.cumsum(size)
        flat = self.numbers[np.repeat(place - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        if marks is None or not len(marks):
            return flat, stops
        marked = marks >= 0
        after = np.cumsum(marked)
        out = np.empty(len(flat) + int(after[-1]), flat.dtype)
        out[np.arange(len(flat)) + np.repeat(after - marked, size)] = flat
        stops = stops + after
        out[stops[marked] - 1] = marks[marked]
        return out, stops


#: Marks that end a token and are no part of a word.
MARKS = b".,;:!?"


def uneven_rows(chunk: Chunk, marks: list[bytes]) -> np.ndarray:
    """Rows of a chunk whose text is not simply tokens with single blanks between them: blanks at an
    end or in a row, one of the marks, or characters that FOREIGN finds."""
    rows, raw, ends = len(chunk), chunk.raw, chunk.ends
    out, blank = np.zeros(rows, bool), raw == 0x20
    row_of = lambda at: np.searchsorted(ends, at, side="right") - 1
    if len(raw) > 1:
        out[row_of(np.flatnonzero(blank[1:] & blank[:-1]))] = True
    filled = np.flatnonzero(np.diff(ends) > 0)
    out[filled[blank[ends[filled]] | blank[ends[filled + 1] - 1]]] = True
    data = raw.tobytes()
    for mark in marks:
        at = data.find(mark)
        while at >= 0:
            out[row_of(at)] = True
            at = data.find(mark, at + 1)
    # Lead bytes from 0xC9 on: characters from U+0240 on.
    for row in np.unique(row_of(np.flatnonzero(raw >= 0xC9))).tolist():
        if not out[row] and FOREIGN.search(data[ends[row]:ends[row + 1]].decode()):
            out[row] = True
    return out


def token_keys(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, head) of the tokens; `head` marks the first of each text, which has no blank before
    it and so a key of its own."""
    hashes, checks, head = chunk.hashes, chunk.second, np.zeros(len(chunk.hashes), bool)
    head[chunk.bounds[:-1][chunk.bounds[:-1] < chunk.bounds[1:]]] = True
    hashes[head] = ~hashes[head]
    checks[head] = ~checks[head]
    return hashes, checks, head


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` word hashes, in order."""
    count = len(hashes) - size + 1
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out *= MIX[0]
        out += hashes[i:count + i]
    return mixed(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The different hashes in ascending order."""
    out = np.sort(hashes)
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) > 1 else out


def shingle_sets(texts: pa.Array, words: Words, size: int):
    """The distinct shingle hashes of each text, in ascending order."""
    for _, chunk in words.chunks(texts):
        for hashes in chunk.shingles(size):
            yield distinct(hashes)


def strings(column: pa.Array) -> Iterator[str | None]:
    """Values one at a time, so that a batch of long texts is not held twice."""
    for value in column:
        yield value.as_py()


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
