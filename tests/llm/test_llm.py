"""The training-data operators on small tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from check_queries import compare, connect  # noqa: E402
from denpyo.llm import (  # noqa: E402
    byte_bpe, common, decontaminate, jaccard_join, language_id, neighbours, quality, queries, sharding, token_counts,
    token_files, url_filters,
)
from denpyo.sources import files  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox and the lazy dog run over 12 hills; " * 4000
TEXTS = [
    None, "", "  \n\t ", "one", "one two three", "One\ttwo  THREE", LONG, LONG, LONG + "tail",
    "日本語のテキスト 東京 ４５ und mehr", "naïve café 🙂🙂 <|endoftext|> x", "a b c d e", "a b c d e f", "###\n\n\n   %%%",
    "it's we'll 123,456.78 \r\n end ", "x" * 3000, "\u00a0\u2003wide\u3000spaces", "İstanbul ẞtraße ŒUVRE",
]
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score STRING, g LONG, host STRING"


def rows_of_documents():
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "s", 1, "h") for i, t in enumerate(TEXTS)]
    return rows + [(3, "one", "en", "src0", 3, "s", 1, "h"), (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_documents(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_against_sql(spark, con, name):
    assert compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLES[name]) is None


# Words ----------------------------------------------------------------------------------------


def test_word_hashes():
    words = common.Words(common.SPACED)
    texts = pa.array(TEXTS * 3, pa.string())
    for column in (texts, texts.slice(5, 20), texts.cast(pa.large_string())):
        known: dict[bytes, int] = {}
        for first, chunk in words.chunks(column):
            for r in range(len(chunk)):
                own = (column[first + r].as_py() or "").encode().lower().split()
                a, b = chunk.bounds[r], chunk.bounds[r + 1]
                assert [chunk.word(i) for i in range(a, b)] == own
                for w, h in zip(own, chunk.hashes[a:b].tolist()):
                    assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


# Jaccard join ---------------------------------------------------------------------------------


def test_driver_gives_back(spark):
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    data = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.byte, 64 << 20)
    held = runtime.totalMemory() - runtime.freeMemory()
    del data  # the JVM's array lives until Python's reference is collected
    common.relieve(spark)
    assert held - (runtime.totalMemory() - runtime.freeMemory()) > 48 << 20


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for x in range(len(order)):
        for y in range(x):
            a, b = sets[order[x]], sets[order[y]]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(order[x]), find(order[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(df).collect()}


def test_jaccard_awkward_rows(docs, empty):
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == len(TEXTS) + 2
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    want = brute_components(dict(enumerate(TEXTS)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert want[7][1] == 6 and want[8][1] == 6 and want[5][1] == 4
    assert jaccard_join.similar_documents(empty).collect() == []


def test_jaccard_near_copies(spark):
    """Copies, chains of edits, a passage in every text, and the limit of four fifths."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 30))
    texts, base = {}, list(rng.choice(vocabulary, 120))
    for i in range(60):  # a chain: each text differs from the one before in a few words
        base[int(rng.integers(120))] = f"edit{i}"
        texts[i] = " ".join(base)
    for i in range(60, 120):  # near copies of one text, some of them beyond the limit of each other
        own = [f"n{i}x{j}" if rng.random() < 0.03 else w for j, w in enumerate(texts[0].split())]
        texts[i] = " ".join(own)
    for i in range(120, 160):
        texts[i] = passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(3, 60))))
    for i in range(160, 200):
        texts[i] = texts[int(rng.integers(160))].upper()
    for i in range(200, 230):  # n shingles, of which 4/5 or just less are shared
        n = 10 + i % 7
        texts[i] = " ".join(f"z{j}" for j in range(n))
    frame = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").repartition(5)
    assert found_components(frame) == brute_components(texts)


def test_jaccard_one_id_on_two_texts(spark):
    """An id that is second in one group and first in another leaves the links of the other group's members."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (6, two), (9, two.replace("b59", "other")), (10, two.replace("b0 ", "other "))]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_documents(frame).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (6, 5), (9, 5), (10, 5)}


def test_jaccard_on_documents(spark):
    frame = common.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert found_components(frame) == brute_components(texts)


# Decontamination ------------------------------------------------------------------------------


def words9(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_contamination(texts, items):
    windows = {}
    for item, text in items:
        own = words9(text)
        if item is None or not own:
            continue
        n = min(13, len(own))
        for i in range(len(own) - n + 1):
            windows.setdefault(tuple(own[i:i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in texts:
        own, hit, found = words9(text), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                names = windows.get(tuple(own[i:i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


ITEMS = [(1, "A b, C d"), (2, "one"), (10, None), (11, " ,, "), (None, "two three"), (12, "a b c d e f g h i j k l m n o"),
         (12, "a b c d e f g h i j k l m n o"), (13, "東京 ４５"), (14, "the lazy dog run over 12 hills; the quick brown fox and the lazy")]


def test_contamination(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], "item_id LONG, text STRING, doc_id INT")
    want = brute_contamination([(r[0], r[1]) for r in rows_of_documents()], ITEMS)
    got = decontaminate.contamination(docs, items).collect()
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert decontaminate.contamination(empty, items).collect() == []
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none) and len(none) == len(got)
    monkeypatch.setattr(decontaminate, "PART_WINDOWS", 4)
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    parts = decontaminate.contamination(unique, items).collect()
    assert {tuple(r) for r in parts} == {w for w in want if w[0] is not None}


def test_removed_documents_and_spans(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id LONG, text STRING")
    bad = {r.doc_id for r in decontaminate.contamination(docs, items).collect() if r.contaminated}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows_of_documents()} - bad and bad
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans").collect()}
    assert cut[3] == "" and cut[4] == " two three" and cut[11] == " e" and cut[13] == TEXTS[13] and cut[0] is None


def test_benchmark_of_several_parts(spark, docs, monkeypatch):
    """Null and repeated ids with unlike texts, and one passage whose windows lie in several parts."""
    passage = " ".join(f"p{i}" for i in range(40))
    items = spark.createDataFrame([*ITEMS, (15, passage)], "item_id LONG, text STRING")
    extra = [(None, "one"), (None, "all of this is clean"), (3, "clean text of an id that a bad one has"),
             (50, f"before {passage} after"), (51, f"{passage}, {passage}"), (52, "p0 p1 p2 and no more")]
    rows = docs.unionByName(spark.createDataFrame(
        [(i, t, "en", None, None, None, None, None) for i, t in extra], DOCS))
    runs = []
    for most in (1 << 21, 4):
        monkeypatch.setattr(decontaminate, "PART_WINDOWS", most)
        runs.append([sorted((tuple(r) for r in f.collect()), key=repr) for f in (
            decontaminate.contamination(rows, items), decontaminate.decontaminate(rows, items),
            decontaminate.decontaminate(rows, items, "spans"))])
    want = brute_contamination([(r[0], r[1]) for r in rows_of_documents()] + extra, [*ITEMS, (15, passage)])
    assert runs[0][0] == want
    assert runs[1] == runs[0]
    assert sum(r[0] is None for r in runs[1][1]) == 2 and [r[1] for r in runs[1][2] if r[0] == 50] == ["before  after"]
    assert decontaminate.find_spans(rows, items).count() == len(want)


# Byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(queries.BPE_RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests_of(library, texts):
    out = []
    for doc, text in texts:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kept", [1 << 19, 3])
def test_byte_bpe(docs, empty, ranks, library, monkeypatch, kept):
    """With and without words in the broadcast."""
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", kept)
    got = byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted([tuple(r) for r in got], key=repr) == digests_of(library, [(r[0], r[1]) for r in rows_of_documents()])
    assert byte_bpe.digests(empty, ranks, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_of_stored_blocks(docs, empty, ranks, monkeypatch):
    """Blocks that are stored in several files before their words are joined give the same rows."""
    monkeypatch.setattr(byte_bpe, "FILE_BLOCKS", 2)
    apart = {"block": 1 << 12, "remembered": 1000, "apart": True}
    want = sorted(byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN).collect(), key=repr)
    assert sorted(byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN, **apart).collect(), key=repr) == want
    assert byte_bpe.digests(empty, ranks, public_tokenizers.PATTERN, **apart).collect() == []


def test_byte_bpe_decodes_words_of_any_length(docs):
    """Two pieces of one id: what comes back is the id's piece, from long words as from short ones."""
    spark, shared = docs.sparkSession, {bytes([b]): b for b in range(256)} | {b"y": ord("x")}
    frame = spark.createDataFrame([(n, "x" * n) for n in (3, byte_bpe.LONG + 1)], "doc_id LONG, text STRING")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.token_ids(frame, shared, public_tokenizers.PATTERN).collect()}
    assert got == {n: b"y" * n for n in (3, byte_bpe.LONG + 1)}


def test_byte_bpe_ids(docs, ranks, library):
    got = {r.doc_id: (r.ids, r.decoded) for r in byte_bpe.token_ids(docs, ranks, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (library.encode_ordinary(text or ""), (text or "").encode())


def test_long_words(spark, ranks, library, monkeypatch):
    """Unbroken runs, on both sides of the length that the fold takes, and beyond what it could number."""
    rng = np.random.default_rng(8)
    runs = ["x" * 255, "x" * 256, "x" * 257, "ab" * 300, "é" * 400, "".join(rng.choice(list("etaoins"), 5000)), "7" * 3000, "!?" * 700]
    for word in runs:
        assert byte_bpe.merged(word.encode(), ranks) == library.encode_ordinary(word), word[:10]
    runs += ["z" * 1_000_000, "y " + "q" * 100_000 + " y"]
    frame = spark.createDataFrame(list(enumerate(runs)), "doc_id LONG, text STRING").repartition(4)
    got = sorted(tuple(r) for r in byte_bpe.digests(frame, ranks, public_tokenizers.PATTERN).collect())
    assert got == digests_of(library, list(enumerate(runs)))


def colliding_words():
    """A Thue-Morse word and its complement: polynomials modulo 2^64 give them one hash, whatever the base. Both
    stand behind the same eight letters."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return "prefixed" + word, "prefixed" + word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_modulo_a_power_of_two(spark, ranks, library):
    one, two = colliding_words()
    text = f"x {one} {two} {two} {one}"
    frame = spark.createDataFrame([(0, text), (1, f"{two} {one}")], "doc_id LONG, text STRING").coalesce(1)
    got = sorted(tuple(r) for r in byte_bpe.digests(frame, ranks, public_tokenizers.PATTERN).collect())
    assert got == digests_of(library, [(0, text), (1, f"{two} {one}")])
    path = public_tokenizers.path(queries.TOKENIZER)
    plain = Tokenizer.from_file(path)
    encoder = token_files.Encoder(path)
    for ids, t in zip(encoder.encode(pa.array([text, f"{two} {one}"])), (text, f"{two} {one}")):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
    rest = "b c d e"
    frame = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest} {two} {rest}")], "doc_id LONG, text STRING")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(frame).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (6, 3)}


def test_kept_tokens():
    """Tokens of one hash but different checks are told apart, in both parts."""
    rng = np.random.default_rng(1)
    kept, known = common.Kept(np.dtype(np.int32)), {}
    kept.RECENT = 300
    for _ in range(20):
        keys = rng.integers(0, 1 << 64, (100, 2), dtype=np.uint64)
        keys[:50, 0] = keys[50:, 0]
        sizes = rng.integers(0, 4, 100)
        codes = rng.integers(0, 1000, int(sizes.sum()), dtype=np.int32)
        kept.add(keys[:, 0].copy(), keys[:, 1].copy(), codes, sizes)
        for k, part in zip(map(tuple, keys.tolist()), np.split(codes, np.cumsum(sizes)[:-1])):
            known[k] = part.tolist()
    asked = np.array(list(known) + [(1, 2), (int(keys[0, 0]), 5)], np.uint64)
    place, size = kept.find(asked[:, 0].copy(), asked[:, 1].copy())
    assert size[-2:].tolist() == [-1, -1]
    flat, stops = kept.gather(place[:-2], size[:-2])
    assert [p.tolist() for p in np.split(flat, stops[:-1])] == list(known.values())


# Token files and counts -----------------------------------------------------------------------


def test_token_files(spark, docs, empty, monkeypatch):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 18)  # several files
    got = token_files.round_trip(docs, path).orderBy("start").collect()
    texts = sorted([(r[0], r[1]) for r in rows_of_documents()], key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for (doc, text), r in zip(texts, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.round_trip(empty, path).collect() == []


def test_one_id_with_many_texts(spark, monkeypatch):
    """An id of very many texts lies in several files; ties have one order, whatever the partitions."""
    path = public_tokenizers.path(queries.TOKENIZER)
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 12)
    frame = spark.createDataFrame([(7, f"text number {i} " * 20) for i in range(100)] + [(1, "a"), (9, "b")], "doc_id LONG, text STRING")
    one, two = (token_files.round_trip(frame.repartition(n), path).orderBy("start").collect() for n in (2, 5))
    assert one == two and [r.doc_id for r in one] == [1] + [7] * 100 + [9]
    folder = files.scratch_dir(spark, "tied")
    manifest = token_files.write(frame, "file://" + folder.removeprefix("file://").removeprefix("file:"), path).collect()
    assert sum(r.n_docs > 0 for r in manifest) > 5


def test_sequences_are_views(spark, docs, tmp_path):
    path = public_tokenizers.path(queries.TOKENIZER)
    folder = f"file://{tmp_path}/out"
    manifest = token_files.write(docs, folder, path, length=64).collect()
    library = Tokenizer.from_file(path)
    texts = sorted([(r[0], r[1]) for r in rows_of_documents()], key=lambda r: -1 if r[0] is None else r[0])
    want = [i for _, t in texts for i in library.encode(t or "", add_special_tokens=False).ids + [0]]
    assert len(manifest) == 1 and manifest[0].n_ids == len(want)
    held = token_files.Sequences(f"{tmp_path}/out/{manifest[0].file}")
    assert len(held) == math.ceil(len(want) / 64)
    for i in (0, 1, len(held) // 2, len(held) - 1):
        ids, mask = held[i]
        own = want[64 * i:64 * (i + 1)]
        assert ids[:len(own)].tolist() == own and mask.true_count == len(own) and not ids.flags.owndata


def test_token_counts(spark, docs, empty, library):
    path = public_tokenizers.path(queries.BPE_RANKS)
    lengths = np.array([len(library.encode_ordinary(r[1] or "")) for r in rows_of_documents()])
    counts = token_counts.histogram(token_counts.token_lengths(docs, path, public_tokenizers.PATTERN)).cache()
    for r in token_counts.context_totals(counts).collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == ((lengths == n).sum(), (lengths > n).sum(), lengths[lengths > n].sum())
        assert (r.docs_within, r.tokens_within) == ((lengths <= n).sum(), lengths[lengths <= n].sum())
        assert r.truncated_total == np.minimum(lengths, n).sum() and r.lost_tokens == lengths.sum() - r.truncated_total
        assert r.quantile == (lengths <= n).mean()
    limits = [0, 1, 7, 10**6]
    assert [(r.limit, r.docs_longer, r.truncated_total) for r in token_counts.truncated_total(counts, limits).collect()] == [
        (n, (lengths > n).sum(), np.minimum(lengths, n).sum()) for n in limits]
    assert token_counts.quantile(counts, 0.5).first()[0] == np.sort(lengths)[math.ceil(len(lengths) / 2) - 1]
    none = token_counts.histogram(token_counts.token_lengths(empty, path, public_tokenizers.PATTERN))
    assert token_counts.context_totals(none).collect() == []


# Sharding -------------------------------------------------------------------------------------


def brute_shards(ids_and_sizes, limit):
    rows = [(i, n, int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)) for i, n in ids_and_sizes]
    out, buckets = [], [(0, 0, rows)]
    while buckets:
        depth, prefix, own = buckets.pop()
        size = sum(n for _, n, _ in own)
        if size > limit and depth < 60:
            for bit in (0, 1):
                half = [r for r in own if r[2] >> (59 - depth) & 1 == bit]
                if half:
                    buckets.append((depth + 1, 2 * prefix + bit, half))
            continue
        name = f"{prefix:0{depth}b}" if depth else ""
        out += [(i, n, name, depth, size, len(own), size <= limit) for i, n, _ in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10, 3_000, 1 << 30])
def test_sharding(docs, empty, limit):
    want = brute_shards([(r[0], len((r[1] or "").encode())) for r in rows_of_documents()], limit)
    assert sorted([tuple(r) for r in sharding.assign(docs, limit).collect()], key=repr) == want
    assert sharding.assign(empty, limit).collect() == []


def test_sharding_of_a_hot_cell(spark):
    """Two ids share a long hash prefix and one row is larger than the limit."""
    sizes = [(i, 50 + i % 7) for i in range(2000)] + [(5000, 100_000)]
    frame = spark.createDataFrame([(i, "x" * n) for i, n in sizes], "doc_id LONG, text STRING")
    assert sorted([tuple(r) for r in sharding.assign(frame, 400).collect()], key=repr) == brute_shards(sizes, 400)


def test_written_shards(spark, docs, tmp_path):
    assert sharding.write_shards(docs, 3_000, str(tmp_path / "shards")) == "shard"
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()
    clashing = docs.withColumnsRenamed({"g": "shard", "host": "shard_id", "score": "shard_1"})
    name = sharding.write_shards(clashing, 3_000, str(tmp_path / "clashing"))
    back = spark.read.parquet(str(tmp_path / "clashing"))
    assert name == "shard_2" and sorted(back.columns) == sorted([*clashing.columns, name])
    assert sorted(map(str, back.drop(name).select(*clashing.columns).collect())) == sorted(map(str, clashing.collect()))


# URL filters ----------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.B.Example.NET/en/x?q#f", "ftp://example.com", "x://y://z/w", "http://ORG/fr/",
            "https://sub.example.com/de/1#a", "http://aexample.com/de/", "http://h.net?x", "http://h.net/"]
    pages = spark.createDataFrame([(i, u, None, "h", "r") for i, u in enumerate(urls)],
                                  "page_id LONG, url STRING, bad INT, host STRING, rule STRING")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, queries.URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.b.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.com", "", None, "allow"),
        5: ("y:", "//z/w", None, "allow"), 6: ("org", "/fr/", "org/fr/", "allow"),
        7: ("sub.example.com", "/de/1", "example.com/de/", "block"), 8: ("aexample.com", "/de/", None, "allow"),
        9: ("h.net", "", None, "allow"), 10: ("h.net", "/", "net/", "block")}
    assert url_filters.judge(pages.limit(0), queries.URL_RULES).collect() == []


def test_host_reputation(spark):
    """Bad hosts are blocked, a single bad page of a good domain is not."""
    rows = [("spam.example.org", 1)] * 60 + [("good.example.org", 0)] * 300 + [("one.example.org", 1)]
    rows += [(f"h{i}.bad.com", 1) for i in range(40)] + [("new.bad.com", None), ("fine.com", 0), ("a.other.net", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id LONG, url STRING, bad INT")
    verdict = {r.host: r.verdict for r in url_filters.judge(pages, []).collect()}
    assert verdict["spam.example.org"] == "block" and verdict["new.bad.com"] == "block"
    assert verdict["good.example.org"] == "allow" and verdict["a.other.net"] == "allow"
    left = url_filters.keep_allowed(pages, [])
    assert left.columns == pages.columns and left.filter("url LIKE '%spam%'").isEmpty()


def test_allowed_pages_of_null_and_repeated_ids(spark):
    rows = [(None, "http://a.net/x"), (None, "http://a.org/x"), (1, "http://a.net/x"), (1, "http://a.org/x"), (1, "http://a.org/x"), (2, None)]
    pages = spark.createDataFrame([(i, u, None, "h", "v") for i, u in rows], "page_id LONG, url STRING, bad INT, judged_host STRING, verdict STRING")
    left = url_filters.keep_allowed(pages, [("block", "net/")])
    assert left.columns == pages.columns
    assert sorted((r.page_id or 0, r.url or "") for r in left.collect()) == [
        (0, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://a.org/x"), (2, "")]
    assert url_filters.keep_allowed(pages.limit(0), []).collect() == []


# Quality --------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    rows = queries.op6_quality(spark, sf).collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([p == q for _, p, q in held]) > 0.93
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1, "x"), (14, 1, "x"), (None, 1, "x"), (13, 0, "x")], "doc_id LONG, quality INT, text STRING")
    scorer = quality.learn(docs, labels)
    rows = quality.score(docs, scorer).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].held_out and by_id[0].score == by_id[1].score
    assert quality.keep_good(docs, scorer).columns == docs.columns
    blank = quality.learn(empty, labels)
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(empty, scorer).collect() == []


def test_scores_against_brute_force(spark):
    """Every document of the table, scored anew from its features."""
    frame = common.table(spark, SF, "documents")
    scorer = quality.learn(frame, common.table(spark, SF, "labels"))
    got = {r.doc_id: r for r in quality.score(frame, scorer).collect()}
    for r in frame.collect():
        x = np.array(quality.features(r.text))
        x = (np.r_[x, np.sqrt(x)] - scorer.mean) / scorer.scale
        score = 1 / (1 + math.exp(-min(30, max(-30, float(x @ scorer.weights[:-1] + scorer.weights[-1])))))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == (score >= quality.CUT)


def test_positive_unlabelled_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.2, 0.05, (4000, len(quality.FEATURES))), rng.normal(0.5, 0.05, (4000, len(quality.FEATURES)))
    unlabelled = np.clip(np.vstack([good[:2800], bad[:1200]]), 0, 1)
    weights, mean, scale, prior = quality.fit(np.clip(good[2800:], 0, 1), unlabelled)
    assert abs(prior - 0.7) < 0.08
    scorer = (np.hstack([unlabelled, np.sqrt(unlabelled)]) - mean) / scale @ weights[:-1] + weights[-1]
    assert (scorer[:2800] > 0).mean() > 0.97 and (scorer[2800:] < 0).mean() > 0.97


# Language ID ----------------------------------------------------------------------------------


def test_language_evidence(spark):
    sf = "/root/testdata/sf0.01"
    table = common.table(spark, sf, "documents")
    model = language_id.fit(table)
    rows = queries.op1_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in table.collect()}
    documents = [r for r in rows if r.kind == "document"]
    assert len(documents) == len(lang) and len(rows) - len(lang) == common.table(spark, sf, "pages").count()
    assert np.mean([r.text_lang == lang[r.doc_id] for r in documents]) > 0.98
    assert all(r.accepted for r in documents)  # clean ones and junk in a language
    # Ambiguous words follow the other evidence; long texts do not.
    long = next(r.text for r in table.filter("lang = 'fr' AND n_chars > 2000").collect())
    made = spark.createDataFrame(
        [(0, "la", "es", None, None), (1, "la", "fr", None, None), (2, "la", None, "http://x.com/es/1", None),
         (3, "la", None, "http://x.fr/", None), (4, long, "de", "http://x.de/", None), (5, None, "de", None, "h"),
         (6, "12 + 3", "de", "bad", None), (7, "", None, None, None)],
        "page_id INT, text STRING, declared STRING, url STRING, lang STRING")
    got = {r.page_id: r for r in language_id.identify(made, model).collect()}
    assert [got[i].lang for i in range(5)] == ["es", "fr", "es", "fr", "fr"]
    assert [got[i].accepted for i in (5, 6, 7)] == [False] * 3 and got[4].accepted
    assert language_id.identify(made.limit(0), model).collect() == []
    assert language_id.fit(table.limit(0)).shape == model.shape


FOREIGN = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir "
          "qual era e cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura! Tant' amara che poco piu morte; "
          "ma per trattar del ben ch' io vi trovai, diro de l' altre cose ch' i' v' ho scorte. " * 2,
    "ru": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 5,
    "salad": "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz    "), 900)),
}


def test_foreign_texts_are_rejected(spark):
    """Whatever they declare; texts of the languages are not, however short."""
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(table)
    rows = [(k, t, declared) for k, t in FOREIGN.items() for declared in (None, "es", "en")]
    rows += [(f"own{r.doc_id}", r.text, None) for r in table.filter("doc_id % 50 = 0").collect()]
    frame = spark.createDataFrame([(k, t, d, None) for k, t, d in rows], "name STRING, text STRING, declared STRING, url STRING")
    got = [(r.name, r.accepted) for r in language_id.identify(frame, model).collect()]
    assert all(accepted == name.startswith("own") for name, accepted in got), [g for g in got if g[1] != g[0].startswith("own")]


def test_language_against_brute_force(spark):
    """Posteriors of every document of the table, computed anew."""
    frame = common.table(spark, SF, "documents")
    model = language_id.fit(frame)
    rows = frame.select("doc_id", "text", frame.lang.alias("declared"), F.lit(None).cast("string").alias("url"), frame.source.alias("host"))
    got = {r.doc_id: r for r in language_id.identify(rows, model).collect()}
    texts = frame.collect()
    evidence = {}
    for r in texts:
        of = language_id.trigrams(r.text)
        mean = model[:, of].mean(axis=1)
        evidence[r.doc_id] = language_id.TEMPER * min(language_id.MOST, len(of)) * (mean - mean.max())
    size = len(language_id.LANGUAGES)
    best = {i: int(e[:size].argmax()) for i, e in evidence.items()}
    counts: dict[str, np.ndarray] = {}
    for r in texts:
        counts.setdefault(r.source, np.zeros(size))[best[r.doc_id]] += 1
    every = sum(counts.values())
    overall = (every + 1) / (every.sum() + size)
    for r in texts:  # a source without a dot is its own domain and suffix
        prior = overall
        for _ in range(3):
            own = counts[r.source]
            prior = (own + language_id.PULL * prior) / (own.sum() + language_id.PULL)
        logs = evidence[r.doc_id].copy()
        wrong = (1 - language_id.DECLARED_RIGHT) / (size - 1)
        logs[:size] += np.log([language_id.DECLARED_RIGHT if r.lang == x else wrong for x in language_id.LANGUAGES]) + np.log(prior)
        logs[size] += -np.log(size) + np.log(language_id.FOREIGN_SHARE)
        posterior = 1 / np.exp(logs - logs[:size].max()).sum()
        row = got[r.doc_id]
        assert row.lang == language_id.LANGUAGES[int(logs[:size].argmax())] and abs(row.posterior - posterior) < 1e-9
        assert row.accepted == (posterior >= language_id.ACCEPT)


def test_markup_is_stripped_in_one_pass():
    plain = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = np.random.default_rng(2)
    parts = ["<script>", "</script >", "<style x>", "</STYLE>", "<!--", "-->", "<b>", "a < b", "text", ">", "<", "</script", "<scripts>"]
    for _ in range(500):
        html = "".join(rng.choice(parts, int(rng.integers(0, 12))))
        assert language_id.without_markup(html) == plain.sub(" ", html), html
    for html in ("<script>" * 200_000, "<!--" * 200_000, "<" * 1_000_000, "<style>x</script>" * 100_000):
        assert len(language_id.without_markup(html)) <= len(html)


def test_host_prior_decides(spark):
    model = language_id.fit(common.table(spark, SF, "documents"))
    long = common.table(spark, SF, "documents").filter("lang = 'de' AND n_chars > 1000").first().text
    german = [(long, None, f"http://a.site.com/{i}", None) for i in range(50)]
    rows = spark.createDataFrame(german + [("la", None, "http://a.site.com/x", "q")], "text STRING, declared STRING, url STRING, q STRING")
    alone = spark.createDataFrame([("la", None, "http://b.org/x", "q")], rows.schema)
    among = next(r for r in language_id.identify(rows, model).collect() if r.q)
    other = language_id.identify(alone, model).first()
    assert among.lang == "de" or (among.text_lang == other.lang and among.posterior < other.posterior)


# Nearest neighbours ---------------------------------------------------------------------------


def brute_neighbours(vectors, every, k):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            usable[i] = np.array(v, np.float64)
    out = []
    for i, v in usable.items():
        if i % every == 0:
            near = sorted(((-float((v * w).sum()), j) for j, w in usable.items() if j != i))[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]  # many equal vectors, queries among them
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [1.0] * 5),
             (405, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (420, [100.0] * 8), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, score DOUBLE").repartition(3)
    got = neighbours.search(frame)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    want = brute_neighbours(rows, 20, 20)
    every = neighbours.search(frame, candidates=10**9).collect()  # all vectors of all trees
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in every) == want
    # With fewer candidates some are missed; what is found has its own score and order.
    found = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect())
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in want}) > 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in brute_neighbours(rows, 20, 1000)}
    assert all(scores[q, i] == s for q, _, i, s in found)
    assert found == sorted((q, rank + 1, i, s) for q in {f[0] for f in found} for rank, (_, i, s) in enumerate(
        sorted((-s, i, s) for p, _, i, s in found if p == q)))
    few = neighbours.search(frame.filter("vec_id IN (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert neighbours.search(frame.limit(0)).collect() == []


def test_neighbours_are_found_through_the_forest(spark, monkeypatch):
    """With few candidates and small pieces the trees decide; recall stays high for clustered vectors."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 50, axis=0) + 0.15 * rng.standard_normal((2000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    monkeypatch.setattr(neighbours, "PIECE", 100)
    got: dict[int, set[int]] = {}
    for r in neighbours.search(frame, candidates=3000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 2000, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & got[i])
    assert len(got) == 100 and hits / 2000 > 0.9


def recall_of(frame, x, every, candidates):
    """(rows of each query, share of the 20 nearest that are found)."""
    got: dict[int, set[int]] = {}
    for r in neighbours.search(frame, every=every, candidates=candidates).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), every):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & got.get(i, set()))
    return {i: len(v) for i, v in got.items()}, hits / 20 / len(range(0, len(x), every))


@pytest.mark.parametrize("size", [3000, 6000, 12000])
def test_neighbours_of_isotropic_vectors(spark, size):
    """The candidates follow from measured recall, whatever the number of vectors."""
    x = np.random.default_rng(size).standard_normal((size, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    rows, recall = recall_of(frame, x, size // 100, 600)
    assert set(rows.values()) == {20} and recall > 0.9


def test_neighbours_of_clusters_take_few_candidates(spark, monkeypatch):
    """The sample shows that the least number of candidates does, so the forest is searched."""
    rng, taken = np.random.default_rng(9), []
    x = np.repeat(rng.standard_normal((100, 16)), 60, axis=0) + 0.1 * rng.standard_normal((6000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    own = neighbours._enough
    monkeypatch.setattr(neighbours, "_enough", lambda *a: taken.append(own(*a)) or taken[-1])
    rows, recall = recall_of(frame, x, 60, 1000)
    assert set(rows.values()) == {20} and recall > 0.9 and taken[0][0] < 3000 and taken[0][1] >= 0.95


def test_neighbours_of_outliers(spark, monkeypatch):
    """Queries in sparsely filled prefixes ascend beyond the cut: one tight cluster, outliers ask."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(16) * 3 + 0.02 * rng.standard_normal((8000, 16))
    x[::200] = 3 * rng.standard_normal((40, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    monkeypatch.setattr(neighbours, "_enough", lambda *a: (a[-1], 1.0), raising=False)  # only the ascent
    rows, _ = recall_of(frame, x, 200, 1500)
    assert len(rows) == 40 and set(rows.values()) == {20}
    monkeypatch.undo()
    rows, recall = recall_of(frame, x, 200, 1500)
    assert set(rows.values()) == {20} and recall > 0.9


# Pipeline -------------------------------------------------------------------------------------


def planted(spark):
    """The documents of the smallest table, foreign texts among them, and an id that stands for two unlike texts
    of which one has a copy."""
    table = common.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in table.collect()}
    good = [r for r in rows.values() if r.n_chars > 1500][:2]
    extra = [(10_000 + i, t, "en", "src1", len(t)) for i, t in enumerate(FOREIGN.values())]
    extra += [(20_000, good[0].text[: 700] + " one tail", "en", "src1", 1), (20_000, good[1].text[-700:] + " another", "en", "src1", 1)]
    return table.unionByName(spark.createDataFrame(extra, table.schema))


def test_pipeline_against_brute_force(spark, library, monkeypatch):
    rows = stored = common.stored(planted(spark), "planted")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: rows if n == "documents" else common.table(s, d, n))
    table = list(enumerate(rows.collect()))
    model = language_id.fit(rows)
    said = rows.select("doc_id", "text", rows.lang.alias("declared"), F.lit(None).cast("string").alias("url"), rows.source.alias("host"))
    accepted = {(r.doc_id, r.copy) for r in language_id.identify(said.withColumn("copy", F.col("text")), model).collect() if r.accepted}
    left = [(k, r) for k, r in table if (r.doc_id, r.text) in accepted]
    assert {r.doc_id for _, r in table} - {r.doc_id for _, r in left} >= {10_000, 10_001, 10_002}
    spoken = spark.createDataFrame([r for _, r in left], stored.schema)
    scorer = quality.learn(spoken, common.table(spark, SF, "labels"))
    scores = np.r_[tuple(scorer(pa.array([r.text])) for _, r in left)]
    left = [(k, r) for (k, r), s in zip(left, scores) if s >= quality.CUT]
    # Groups of rows, of which the one with the smallest id stays.
    group = brute_components({k: r.text for k, r in left})
    first: dict[int, tuple] = {}
    for k, r in left:
        first[group[k][1]] = min(first.get(group[k][1], (r.doc_id, k)), (r.doc_id, k))
    kept = [(k, r) for k, r in left if first[group[k][1]] == (r.doc_id, k)]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    clean = [(r.doc_id, r.text) for _, r in kept if not brute_contamination([(r.doc_id, r.text)], items)[0][-1]]
    assert len(clean) < len(kept) < len(left) < len(table)
    got = sorted([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], key=repr)
    assert got == digests_of(library, clean)


def test_pipeline_stages_keep_the_columns(spark, docs):
    """Awkward rows pass every stage; each stage returns the columns of documents."""
    table = common.table(spark, SF, "documents")
    rows = table.unionByName(docs.select(
        (docs.doc_id + 100_000).alias("doc_id"), "text", "lang", "source", "n_chars")).unionByName(table.filter("doc_id < 3"))
    rows = common.stored(rows, "awkward")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.stored(stage(spark, rows, SF), name)
        assert rows.columns == table.columns
    seen = Counter(r.doc_id for r in rows.select("doc_id").collect() if r.doc_id is not None)
    assert max(seen.values()) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert len(last) == rows.count()


def test_empty_pipeline(spark):
    rows = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.collect() == []


def test_scratch_needs_a_shared_folder(spark):
    assert files.scratch_dir(spark, "x").startswith(files.scratch_root(spark))
