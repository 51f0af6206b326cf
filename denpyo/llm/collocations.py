"""Phrase collocations from weighted acyclic automata.

Method: a count transducer is an acyclic automaton whose paths are n-grams and whose weights are their
counts. Here a state is an n-gram: the arc that enters it comes from the state of its first n - 1
words (`prefix`), and a second arc points to the state of its last n - 1 words (`suffix`), which
together say which word the arc reads. An n-gram is therefore one pair of states.

* Each shard (`SHARD` bytes of text) grows its own transducer level by level: the n-grams of one
  length, sorted, give the arcs to those of the next.
* The shards' arcs are united by prefix range, adding up their weights. Only states of at least
  `least` occurrences go on: whatever an n-gram is part of is no more frequent than the n-gram, so no
  longer phrase is lost, and each level is much smaller than all n-grams of its length.
* The union tells each shard the numbers of its own arcs that are left, and it continues with these.
* Part counts need no search: prefix and suffix arcs are composed, so that a state carries the
  counts of all phrases that it begins with and ends with.

How it is distributed: a shard's arcs travel as one packed piece for each prefix range (the first word's hash;
as many ranges as the text asks for). Ranges whose pieces hold more than `MOST` arcs, those of frequent
words, are cut by their suffixes before they meet, so a task unites a bounded number of arcs; one
arc has at most as many rows as there are shards. Nothing is broadcast but the sizes of ranges (counted), and
no level is ever in one place. A task holds one shard, or one range.

Words are identified by their bytes: a shard finds equal words by hash and then compares them.

Results by case: null text is the empty one, which has no words; a null language is `und`; repeated rows
and null ids count like all others; an empty table gives no rows. A document lies in one shard,
whatever its length. All counts and scores are integers, products have 38 decimal digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX, Words, bounded, lean, mixed, sent, stored

#: Occurrences of a phrase, its words, scale of the score, share of a longer phrase, rows of a language.
LEAST, LONGEST, SCALE, ABSORBED, FIRST = 30, 4, 2_000_000, 80, 2000
#: Bytes of text of one shard, and of one prefix range; arcs that one task unites.
SHARD, RANGE, MOST = 8 << 20, 2 << 20, 1 << 20
#: A state's number: its range, the part of the range, and its place there.
PART_BITS, PLACE_BITS = 12, 24

_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A-Z count as a-z; blanks and what ends a piece separate words.
_FOLD = bytes(0x20 if b in _ENDS + _BLANKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_END = np.isin(np.arange(256), list(_ENDS))

#: What a shard writes: its text as numbers of arcs (range -1; -1 where no arc is), and packed arcs by range.
_PIECES = "shard LONG, range LONG, rows LONG, data BINARY"
#: What a range writes: states, and for each shard its arcs that have a state, with the state's number.
_UNITED = "id LONG, word BINARY, prefix LONG, suffix LONG, f LONG, shard LONG, data BINARY"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns, compressed: numbers by the places of their bytes, as most high bytes are equal."""
    data = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: pa.Scalar, rows: int | None, *types: str) -> list[np.ndarray]:
    """The columns that were packed, all of so many rows but the last, which has the rest."""
    raw = memoryview(data.as_buffer())
    held = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), np.uint8)
    out, at = [], 0
    for i, kind in enumerate(map(np.dtype, types)):
        size = rows * kind.itemsize if i + 1 < len(types) else len(held) - at
        out.append(held[at:at + size].reshape(kind.itemsize, -1).T.copy().view(kind).ravel())
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, of which `np.cumsum` makes the numbers again."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values in ascending order, the place of each among them)."""
    found = pa.array(values).dictionary_encode()
    kinds = found.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    return kinds[order], rank[found.indices.to_numpy()]


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _firsts(codes: np.ndarray, count: int) -> np.ndarray:
    """Where each number occurs first."""
    out = np.empty(count, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def _same(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, twin: np.ndarray) -> bool:
    """Whether every word has the bytes of the word that `twin` names."""
    size = stops - starts
    if (size != size[twin]).any():
        return False
    eights = np.ndarray((len(raw) + 1,), "<u8", np.r_[raw, np.zeros(8, np.uint8)], strides=(1,))
    left, done = np.flatnonzero(twin != np.arange(len(twin))), 0
    while len(left):
        bits = np.minimum(size[left] - done, 8).astype(np.uint64) * np.uint64(8)
        mask = ~np.uint64(0) >> (np.uint64(64) - bits)
        if ((eights[starts[left] + done] ^ eights[starts[twin[left]] + done]) & mask).any():
            return False
        done += 8
        left = left[size[left] > done]
    return True


def _distinct_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, lang: np.ndarray):
    """(a place of each different word of a language, number of each word among them)."""
    found = pa.array(hashes + lang.astype(np.uint64) * MIX[0]).dictionary_encode()
    number, count = found.indices.to_numpy(), len(found.dictionary)
    first = _firsts(number, count)
    if (lang == lang[first[number]]).all() and _same(raw, starts, stops, first[number]):
        return first, number
    known: dict[tuple, int] = {}
    data = raw.tobytes()
    number = np.array([known.setdefault((g, data[a:b]), len(known)) for g, a, b in zip(lang.tolist(), starts.tolist(), stops.tolist())])
    return _firsts(number, len(known)), number


def _without_runs(codes: np.ndarray) -> np.ndarray:
    """Of consecutive gaps (-1) one is enough."""
    gap = codes < 0
    return codes[~(gap & np.r_[True, gap[:-1]])] if len(codes) else codes


def _rows(shard: int, codes: np.ndarray, pieces: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """A shard's codes and pieces (range, rows, data) as _PIECES."""
    rows = [(-1, len(codes), _pack(codes.astype(np.int32))), *pieces]
    ranges, sizes, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), shard, np.int64)), pa.array(ranges, pa.int64()), pa.array(sizes, pa.int64()),
         pa.array(data, pa.binary())], ["shard", "range", "rows", "data"])


class _Text:
    """Words of the texts of one shard."""

    def __init__(self, ranges: int):
        self.words, self.ranges = Words(_FOLD, seed=None), ranges
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.langs: dict[str, int] = {}
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in batch.column(0).to_pylist()], np.uint64)
        for first, chunk in self.words.chunks(batch.column(1)):
            ends = np.flatnonzero(_IS_END[chunk.raw])
            cut = np.ones(len(chunk.starts), bool)
            cut[1:] = np.diff(np.searchsorted(ends, chunk.starts)) > 0
            cut[chunk.bounds[:-1][chunk.bounds[:-1] < len(cut)]] = True
            lang = np.repeat(langs[first:first + len(chunk)], np.diff(chunk.bounds))
            starts, stops = ((x + self.size).astype(np.int32) for x in (chunk.starts, chunk.stops))
            self.parts.append((chunk.fold[chunk.raw], starts, stops, chunk.hashes, cut, lang.astype(np.uint32)))
            self.size += len(chunk.raw)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        raw, starts, stops, hashes, cut, lang = map(np.concatenate, zip(*self.parts))
        langs = [g.encode() + b" " for g in self.langs]
        self.clear()
        if not len(starts):
            return
        own, number = _distinct_words(raw, starts, stops, hashes, lang)
        size = stops[own] - starts[own]
        at = np.cumsum(size) - size
        words = _binaries(size, raw[np.repeat(starts[own] - at, size) + np.arange(int(size.sum()))])
        # A word never has a blank, so language and word are told apart in a key. The language alone stands for
        # all of its words.
        keys = pc.binary_join_element_wise(pa.array(langs, pa.binary()).take(pa.array(lang[own])), words, b"")
        keys = pa.concat_arrays([keys, pa.array(langs, pa.binary())])
        counts = np.r_[np.bincount(number, minlength=len(own)), np.bincount(lang.astype(np.int64), minlength=len(langs))]
        codes = np.full(len(number) + int(cut.sum()), -1, np.int64)
        codes[np.arange(len(number)) + np.cumsum(cut)] = number
        yield _rows(shard, codes, self._pieces(keys, counts, len(own)))

    def _pieces(self, keys: pa.Array, counts: np.ndarray, words: int) -> Iterator[tuple[int, int, bytes]]:
        listed = keys.to_pylist()
        ranges = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % self.ranges
        arc = np.where(np.arange(len(listed)) < words, np.arange(len(listed)), -1).astype(np.int32)
        order = np.argsort(ranges, kind="stable")
        cuts = np.flatnonzero(np.diff(ranges[order])) + 1
        for own in np.split(order, cuts):
            some = [listed[i] for i in own.tolist()]
            some, place = zip(*sorted(zip(some, own.tolist())))
            place = list(place)
            sizes = np.fromiter(map(len, some), np.int32, len(some))
            yield int(ranges[place[0]]), len(some), _pack(
                sizes, counts[place].astype(np.int64), arc[place], np.frombuffer(b"".join(some), np.uint8))


def _shards(docs: DataFrame) -> DataFrame:
    """The texts in shards, and the words of each shard with their counts (_PIECES)."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 16 + (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        text, shard = _Text(ranges), TaskContext.get().partitionId() << 32
        for batch in batches:
            text.add(batch)
            if text.size >= SHARD:
                yield from text.rows(shard)
                shard += 1
        if text.size:
            yield from text.rows(shard)

    return stored(bounded(own).mapInArrow(task, _PIECES), "phrase-shards")


def _grown(shards: DataFrame, united: DataFrame) -> DataFrame:
    """The shards one level on: arcs are pairs of neighbouring states, codes their numbers (_PIECES)."""
    texts = shards.filter("range = -1").select("shard", "rows", "data")
    known = united.filter("shard IS NOT NULL").select(F.col("shard").alias("of"), "data")

    def grow(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["shard", "range", "rows", "data"])
        if not left.num_rows or not right.num_rows:
            return none
        codes, = _unpack(left.column("data")[0], None, "<i4")
        ids, arc = (np.concatenate(c) for c in zip(*(_arcs(d) for d in right.column("data"))))
        number = np.full(max(int(codes.max()), int(arc.max())) + 2, -1, np.int64)  # the last one is of gaps
        every, place = _numbered(ids)
        number[arc] = place
        at = number[codes]
        whole = (at[:-1] >= 0) & (at[1:] >= 0)
        if not whole.any():
            return none
        pairs, own = _numbered(at[:-1][whole] * len(every) + at[1:][whole])
        out = np.full(len(whole), -1, np.int64)
        out[whole] = own
        prefix, suffix, count = every[pairs // len(every)], every[pairs % len(every)], np.bincount(own)
        ranges = prefix >> PART_BITS + PLACE_BITS
        cuts = np.r_[0, np.flatnonzero(np.diff(ranges)) + 1, len(ranges)]
        pieces = ((int(ranges[a]), b - a, _pack(
            _steps(prefix[a:b]), suffix[a:b], count[a:b].astype(np.int64), _steps(np.arange(a, b, dtype=np.int32))))
                  for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.Table.from_batches([_rows(left.column("shard")[0].as_py(), _without_runs(out), pieces)])

    joined = texts.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(grow, _PIECES)
    return stored(joined, "phrase-shards")


def _arcs(data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(states, arcs) that a range has told a shard."""
    both, = _unpack(data, None, "<i8")
    return both[:len(both) // 2], both[len(both) // 2:]


def _paired(data: pa.Scalar, rows: int) -> list[np.ndarray]:
    """(prefix, suffix, count, arc) of a piece of pairs."""
    prefix, suffix, count, arc = _unpack(data, rows, "<i8", "<i8", "<i8", "<i4")
    return [np.cumsum(prefix), suffix, count, np.cumsum(arc, dtype=np.int32)]


def _dealt(shards: DataFrame, by_word: bool) -> DataFrame:
    """The pieces with `part`: those of a large range cut by their suffixes (words, on the first level)."""
    pieces = shards.filter("range >= 0")
    sizes = pieces.groupBy("range").agg(F.ceil(F.sum("rows") / MOST).cast("int").alias("parts"))
    pieces = pieces.join(sent(sizes), "range")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            out = []
            for key, shard, rows, data, parts in zip(*(batch.column(i) for i in range(5))):
                key, shard, rows, parts = key.as_py(), shard.as_py(), rows.as_py(), parts.as_py()
                if by_word:
                    sizes, count, arc, words = _unpack(data, rows, "<i4", "<i8", "<i4", "u1")
                    listed = _binaries(sizes, words).to_pylist()
                    part = np.fromiter(map(zlib.adler32, listed), np.int64, rows) % parts
                else:
                    prefix, suffix, count, arc = _paired(data, rows)
                    part = (mixed(suffix.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part).tolist():
                    own = np.flatnonzero(part == p)
                    if by_word:
                        some = b"".join(listed[i] for i in own.tolist())
                        packed = _pack(sizes[own], count[own], arc[own], np.frombuffer(some, np.uint8))
                    else:
                        packed = _pack(_steps(prefix[own]), suffix[own], count[own], _steps(arc[own]))
                    out.append((key, shard, len(own), packed, p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))],
                ["range", "shard", "rows", "data", "part"])

    names = ["range", "shard", "rows", "data"]
    few = pieces.filter("parts <= 1").select(*names, F.lit(0).alias("part"))
    many = pieces.filter("parts > 1").select(*names, "parts").mapInArrow(
        cut, "range LONG, shard LONG, rows LONG, data BINARY, part INT")
    return few.union(many)


def _united(shards: DataFrame, by_word: bool, least: int) -> DataFrame:
    """States of at least `least` occurrences, and what each shard needs to know of them (_UNITED): the arcs of all
    shards, their weights added up within each prefix range."""

    def unite(group: pa.Table) -> pa.Table:
        rows, data = group.column("rows").to_pylist(), group.column("data")
        if by_word:
            sizes, counts, arcs, words = (np.concatenate(c) for c in zip(*(
                _unpack(d, r, "<i4", "<i8", "<i4", "u1") for d, r in zip(data, rows))))
            found = _binaries(sizes, words).dictionary_encode()
            keys, number = found.dictionary, found.indices.to_numpy().astype(np.int64)
            order = pc.sort_indices(keys).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            keys, number = keys.take(pa.array(order)), rank[number]
        else:
            prefix, suffix, counts, arcs = (np.concatenate(c) for c in zip(*(
                _paired(d, r) for d, r in zip(data, rows))))
            before, p = _numbered(prefix)
            behind, s = _numbered(suffix)
            pairs, number = _numbered(p * len(behind) + s)
        f = np.zeros(int(number.max()) + 1, np.int64)
        np.add.at(f, number, counts)
        kept = f >= least
        if by_word:
            kept |= pc.ends_with(keys, b" ").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept)
        first = group.column("range")[0].as_py() << PART_BITS + PLACE_BITS | group.column("part")[0].as_py() << PLACE_BITS
        ids = np.full(len(f), -1, np.int64)
        ids[at] = first + np.arange(len(at))
        none = pa.nulls(len(at), pa.int64())
        named = [pa.array(ids[at]), keys.take(pa.array(at)), none, none] if by_word else [
            pa.array(ids[at]), pa.nulls(len(at), pa.binary()), pa.array(before[pairs[at] // len(behind)]), pa.array(behind[pairs[at] % len(behind)])]
        states = pa.table(named + [pa.array(f[at]), none, pa.nulls(len(at), pa.binary())], names=_NAMES)
        # What each shard keeps.
        mine, told = ids[number], []
        for shard, a, b in zip(group.column("shard").to_pylist(), np.cumsum(rows) - rows, np.cumsum(rows)):
            own = np.flatnonzero((mine[a:b] >= 0) & (arcs[a:b] >= 0)) + a
            if len(own):
                told.append((shard, _pack(np.r_[mine[own], arcs[own]])))
        empty = pa.nulls(len(told), pa.int64())
        back = pa.table([empty, pa.nulls(len(told), pa.binary()), empty, empty, empty, pa.array([t[0] for t in told], pa.int64()),
                         pa.array([t[1] for t in told], pa.binary())], names=_NAMES)
        return pa.concat_tables([states, back])

    return stored(_dealt(shards, by_word).groupBy("range", "part").applyInArrow(unite, _UNITED), "phrase-states")


_NAMES = ["id", "word", "prefix", "suffix", "f", "shard", "data"]


class Levels:
    """The transducer of a corpus: its states by their number of words, and the words of each language."""

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST):
        shards = _shards(docs)
        levels = [_united(shards, True, least)]
        for _ in range(longest - 1):
            shards = _grown(shards, levels[-1])
            levels.append(_united(shards, False, least))
        key = F.col("word").cast("string")
        word = F.substring_index(key, " ", -1)
        first = levels[0].filter("id IS NOT NULL").select(
            "id", F.left(key, F.length(key) - F.length(word) - 1).alias("lang"), word.alias("word"), "f")
        self.words = first.filter("word = ''").select("lang", F.col("f").alias("n"))
        self.states = self._composed(
            first.filter("word <> '' AND f >= " + str(least)),
            [level.filter("id IS NOT NULL").select("id", "prefix", "suffix", "f") for level in levels[1:]])

    @staticmethod
    def _composed(first: DataFrame, longer: list[DataFrame]) -> list[DataFrame]:
        """States with their phrase and last word, and the counts of the phrases they begin with (`heads`, of
        1, 2, ... words) and end with (`tails`, of all words, one less, ...)."""
        none = F.lit(None).cast("long")
        out = [first.select("id", none.alias("prefix"), none.alias("suffix"), "lang", F.col("word").alias("phrase"),
                            F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))]
        for level in longer:
            before = out[-1].select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"), "heads")
            behind = out[-1].select(F.col("id").alias("suffix"), "last", "tails")
            out.append(stored(level.join(before, "prefix").join(behind, "suffix").select(
                "id", "prefix", "suffix", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f",
                F.concat("heads", F.array("f")).alias("heads"), F.concat(F.array("f"), "tails").alias("tails")), "phrase-levels"))
        return out


def _product(a: Column, b: int) -> Column:
    return a.cast("decimal(19,0)") * F.lit(b).cast("decimal(10,0)")


def _cut(words: int, scale: int) -> Column:
    """The cut of the lowest score, the first of equal ones: STRUCT<score, k, l, r>."""

    def cut(k: int) -> Column:
        left, right = F.get("heads", k - 1), F.get("tails", k)
        # Both parts occur as often as the phrase at least, so the quotient is at most half the scale.
        both = left.cast("decimal(19,0)") + right.cast("decimal(19,0)")
        score = F.call_function("div", _product(F.col("f"), scale), both)
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, words)]))


def candidates(levels: Levels, scale: int = SCALE, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one absorbs.

    A longer phrase that holds a phrase is at least as rare as the phrases between them, so it is
    enough to look at those of one more word, which are the states that name this one as prefix or suffix.
    """
    out = None
    for i, level in enumerate(levels.states[1:], start=2):
        rows = level.select("id", "lang", "phrase", F.col("f").alias("a"), _cut(i, scale).alias("cut"))
        if i < len(levels.states):
            longer = levels.states[i]
            arcs = longer.select(F.col("prefix").alias("id"), "f").union(longer.select(F.col("suffix").alias("id"), "f"))
            most = arcs.groupBy("id").agg(F.max("f").alias("most"))
            rows = rows.join(most, "id", "left").filter(
                F.col("most").isNull() | (_product(F.col("most"), 100) < _product(F.col("a"), absorbed)))
        part = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = part if out is None else out.union(part)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, scale: int = SCALE,
                 absorbed: int = ABSORBED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language of documents (text, lang)."""
    levels = Levels(docs, least, longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(levels, scale, absorbed).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(levels.words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def part_counts(levels: Levels, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, f, heads, tails) of the given (lang, phrase), null counts where a phrase is too rare."""
    every = None
    for level in levels.states:
        own = level.select("lang", "phrase", "f", "heads", "tails")
        every = own if every is None else every.union(own)
    return phrases.select("lang", "phrase").join(every, ["lang", "phrase"], "left")
