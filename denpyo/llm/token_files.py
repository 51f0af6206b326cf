"""Token ids as Arrow stream files of equal-length sequences.

Format: a file is one Arrow IPC stream. Each record batch has `ids` (fixed-size list of unsigned
integers, 16 bits if the vocabulary allows), `mask` (fixed-size list of booleans, false behind the
last id of the file), `starts` (fixed-size list of booleans, true on a document's first id) and
`doc_ids` (list: the documents that begin in the sequence). A mapped file is read without a
copy: batch and row of a sequence follow from its number (`Sequences`).

Documents are ordered by id over all files: a range partitioning, so each task sorts and writes
its own range; equal ids are ordered by size, start and text, so an id with very many texts lies in several
files. A file is written under a temporary name and then renamed, so a task that is
repeated replaces its own file. Files go to any store that `pyarrow.fs` opens; they are read
back by Spark's own reader.

Encoding uses the tokenizers library. With a byte-level pre-tokenizer a text is split before every
single blank, so what stands between two blanks has the same ids in all texts. Tasks hash these
tokens (two polynomials at bases that each worker draws, beside length and first bytes) and keep their ids in flat arrays,
some 40 bytes each, for as long as a Python worker lives; only new ones are encoded, many at a time. Texts with two blanks in a row, with
special tokens or with other scripts than Latin are encoded whole.

Results by case: null and empty texts have the end id alone; documents with equal ids follow each
other by size, start and text; null ids come first; an empty table gives one file without sequences.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_dir
from .common import BLANKS, MARKS, Chunk, Kept, Words, bounded, kept_by_worker, lean, stored, token_keys, uneven_rows

SEQUENCE = 2048
#: Sequences of a record batch, bytes of text that one file holds at least and at most (a thousandth of all
#: between these), tokens kept by a Python worker.
BATCH, FILE_BYTES, LARGEST_FILE, KEPT = 64, 16 << 20, 256 << 20, 1_200_000

class Encoder:
    """Ids of texts, by the tokens between blanks."""

    def __init__(self, path: str):
        # Tasks are parallel already; threads of a worker would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        top = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        # A byte-level vocabulary writes each byte as one character.
        self.sizes = np.zeros(top + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"] or {}
        self.by_blanks = split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"] \
            and spec["normalizer"] is None
        self.words = Words(BLANKS, second=True, seed=None, marks=MARKS)
        self.marks = np.full(256, -1, np.int64)
        for mark in MARKS:
            codes = self.whole(chr(mark))
            self.marks[mark] = int(codes[0]) if len(codes) == 1 else -1
        if (self.marks[list(MARKS)] < 0).any():
            self.words.marks[:] = False  # a vocabulary without them
        self.kept = Kept(self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def learn(self, chunk: Chunk, hashes: np.ndarray, checks: np.ndarray, new: np.ndarray, head: np.ndarray) -> None:
        """Encode new tokens of a chunk. Those behind a blank are split the same way when they follow each other,
        so many are encoded as one text and told apart by their bytes; the first ones of texts stand alone."""
        behind, alone = new[~head[new]], new[head[new]]
        runs = [chunk.spaced(behind[i:i + 1000]) for i in range(0, len(behind), 1000)]
        texts = [r.decode() for r, _ in runs] + [chunk.word(i).decode() for i in alone.tolist()]
        codes = [np.array(c.ids, np.int64) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        size = np.r_[chunk.stops[behind] - chunk.starts[behind] + 1, chunk.stops[alone] - chunk.starts[alone]]
        ends = np.searchsorted(np.cumsum(self.sizes[flat]), np.cumsum(size)) + 1
        own = np.r_[behind, alone]
        self.kept.add(hashes[own], checks[own], flat.astype(self.dtype), np.diff(np.r_[0, ends]))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.kept) > KEPT:
            self.kept = Kept(self.dtype)
        for first, chunk in self.words.chunks(texts):
            alone = uneven_rows(chunk, self.special) if self.by_blanks else np.diff(chunk.ends) > 0
            hashes, checks, head = token_keys(chunk)
            skipped = np.repeat(alone, np.diff(chunk.bounds))
            place, size = self.kept.find(hashes, checks)
            missing = np.flatnonzero((size < 0) & ~skipped)
            while len(missing):  # again for tokens of one hash that differ in their check
                _, once = np.unique(hashes[missing], return_index=True)
                self.learn(chunk, hashes, checks, missing[once], head)
                place[missing], size[missing] = self.kept.find(hashes[missing], checks[missing])
                missing = missing[size[missing] < 0]
            size[skipped] = 0
            marks = None if chunk.tail is None else np.where(skipped, -1, self.marks[chunk.tail])
            flat, stops = self.kept.gather(place, size, marks)
            ends = np.r_[0, stops][chunk.bounds]
            for row in range(len(chunk)):
                yield self.whole(texts[first + row].as_py()) if alone[row] else flat[ends[row]:ends[row + 1]]


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ("starts", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))])


def _batch(schema: pa.Schema, ids: np.ndarray, starts: np.ndarray, docs: list) -> pa.RecordBatch:
    """Sequences of the ids, the last one filled up; `starts` are positions of first ids."""
    length = schema.field("ids").type.list_size
    rows = -(-len(ids) // length)
    flat = np.zeros(rows * length, ids.dtype)
    flat[:len(ids)] = ids
    first = np.zeros(rows * length, bool)
    first[starts] = True
    ends = np.searchsorted(starts, np.arange(rows + 1) * length).astype(np.int32)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), length)
             for v in (flat, np.arange(rows * length) < len(ids), first)]
    return pa.RecordBatch.from_arrays(
        lists + [pa.ListArray.from_arrays(pa.array(ends), pa.array(docs, pa.int64()))], schema=schema)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """Write documents (doc_id, text) to `folder`; one row (part, file, n_docs, n_ids) per file."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // min(max(FILE_BYTES, size // 1000), max(FILE_BYTES, LARGEST_FILE))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        import pyarrow.fs

        lean()
        part = TaskContext.get().partitionId()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{part:06d}.arrow"
        trial = f"{root}/_{name}.{uuid.uuid4().hex}"
        encoder = kept_by_worker("encoder", tokenizer, lambda: Encoder(tokenizer))
        schema = _schema(encoder.dtype, length)
        end = np.array([end_id], encoder.dtype).tobytes()
        full = BATCH * length
        pending, starts, held, n_docs, n_ids = bytearray(), [], [], 0, 0
        with store.open_output_stream(trial) as sink, pa.ipc.new_stream(sink, schema) as out:
            def flush(last: bool) -> None:
                nonlocal pending, starts, held
                width = encoder.dtype.itemsize
                while len(pending) >= full * width or (last and pending):
                    ids = np.frombuffer(bytes(pending[:full * width]), encoder.dtype)
                    inside = int(np.searchsorted(starts, len(ids)))
                    out.write_batch(_batch(schema, ids, np.array(starts[:inside], np.int64), held[:inside]))
                    pending = pending[full * width:]
                    starts, held = [s - len(ids) for s in starts[inside:]], held[inside:]

            for batch in batches:
                for doc, code in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    starts.append(len(pending) // encoder.dtype.itemsize)
                    held.append(doc)
                    pending.extend(code.tobytes())
                    pending.extend(end)
                    n_docs, n_ids = n_docs + 1, n_ids + len(code) + 1
                    flush(False)
            flush(True)
        store.move(trial, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name],
                                          "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    # Enough to tell most texts of one id apart without reading them whole.
    tied = bounded(own).withColumns({"size": F.octet_length("text"), "start": F.xxhash64(F.substring("text", 1, 128))})
    ordered = tied.repartitionByRange(files, "doc_id", "size", "start").sortWithinPartitions(
        "doc_id", "size", "start", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(pack, "part INT, file STRING, n_docs LONG, n_ids LONG"), "token-manifest")


def _documents(stream) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a stream in order; a document may span sequences and batches."""
    doc, held = None, []
    for batch in pa.ipc.open_stream(stream):
        ids = batch.column("ids").flatten().to_numpy()
        ids = ids[:batch.column("mask").flatten().true_count]
        first = np.flatnonzero(batch.column("starts").flatten().to_numpy(zero_copy_only=False)[:len(ids)])
        docs = batch.column("doc_ids").flatten().to_pylist()
        cuts = np.r_[first, len(ids)]
        if held:
            held.append(ids[:cuts[0]])
        for name, a, b in zip(docs, cuts[:-1], cuts[1:]):
            if held:
                yield doc, np.concatenate(held)
            doc, held = name, [ids[a:b]]
    if held:
        yield doc, np.concatenate(held)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, position, doc_id, n_tokens, ids_crc32) from the files, position within a file.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = int(re.search(r"part-(\d+)\.arrow$", path)[1])
                rows, position = [], 0
                for doc, ids in _documents(content.as_buffer()):
                    rows.append((part, position, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    position += len(ids)
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.int64()] * 4)],
                    ["part", "position", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder)
    return files.select("path", "content").mapInArrow(
        unpack, "part INT, position LONG, doc_id LONG, n_tokens LONG, ids_crc32 LONG")


def index(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all files: start counts the ids before."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return read(spark, folder).join(offsets, "part").select(
        "doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


class Sequences:
    """Random access to the sequences of one file, mapped or in a buffer."""

    def __init__(self, source):
        self.batches = list(pa.ipc.open_stream(pa.memory_map(source) if isinstance(source, str) else source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i: views of the file's own memory."""
        b = int(np.searchsorted(self.ends, i, side="right"))
        row = i - (int(self.ends[b - 1]) if b else 0)
        batch = self.batches[b]
        ids = batch.column("ids").flatten().to_numpy()[row * self.length:(row + 1) * self.length]
        return ids, batch.column("mask").flatten().slice(row * self.length, self.length)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents to a new shared folder and return the index read from its files."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "token-files")
    if "://" not in folder:
        folder = ("file://" if folder.startswith("/") else "") + folder.replace("file:/", "file:///", 1)
    manifest = write(docs, folder, tokenizer)
    return index(spark, folder, manifest)
