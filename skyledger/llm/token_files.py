"""Token ids in binary files whose blocks are shuffled into planes.

A file holds blocks of BLOCK ids. A block is transposed: plane p has byte p (or bit p) of every id. A plane is compressed with
zstandard by itself; a plane of zeros takes no room. Two more blocks of 64-bit numbers hold the documents' ids and lengths.
The chunk index ends the file, so that a reader can go to any block:

    MAGIC | planes of block 0 | planes of block 1 | ... | index (JSON, zstandard) | its length (8 bytes) | MAGIC

A task writes to a name of its own, which the manifest keeps: of a task that runs twice one attempt's file is in it, and the other is never read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import kept_in_worker

MAGIC = b"SKYPLANE"
BLOCK = 1 << 16
#: Words of which a worker keeps the ids; the store is emptied when it is full (about 250 MB).
CACHED_WORDS = 1_500_000


def planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """The compressed planes of an unsigned integer array, least significant first; b'' for a plane of zeros."""
    width = values.dtype.itemsize
    rows = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"), copy=False).view(np.uint8).reshape(-1, width).T)
    if bits:
        rows = np.concatenate([np.packbits((row >> b) & 1)[None] for row in rows for b in range(8)])
    squeeze = zstandard.ZstdCompressor(level=3)
    return [squeeze.compress(row.tobytes()) if row.any() else b"" for row in rows]


def unplaned(parts: list[bytes], n: int, dtype: str, bits: bool = False) -> np.ndarray:
    """The array whose planes these are."""
    expand = zstandard.ZstdDecompressor()
    size = (n + 7) // 8 if bits else n
    rows = [np.frombuffer(expand.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in parts]
    if bits:
        rows = [sum(np.unpackbits(row, count=n) << b for b, row in enumerate(rows[i : i + 8])) for i in range(0, len(rows), 8)]
    return np.ascontiguousarray(np.stack(rows).T.astype(np.uint8)).reshape(-1).view(dtype)[:n] if n else np.zeros(0, dtype)


class PlaneWriter:
    """Writes documents' ids in order to an open binary file; holds one block and the documents' numbers."""

    def __init__(self, sink, bits: bool = False):
        self.sink, self.bits, self.at = sink, bits, 0
        self.held, self.n_held = [], 0
        self.index: dict = {"bits": bits, "blocks": [], "n": 0}
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _block(self, values: np.ndarray) -> dict:
        entry = {"at": self.at, "n": len(values), "planes": []}
        for part in planes(values, self.bits):
            entry["planes"].append(len(part))
            self._put(part)
        return entry

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            every = np.concatenate(self.held)
            for start in range(0, len(every) - BLOCK + 1, BLOCK):
                self.index["blocks"].append(self._block(every[start : start + BLOCK]))
            self.held = [every[len(every) - len(every) % BLOCK :]]
            self.n_held = len(self.held[0])

    def close(self) -> int:
        if self.n_held:
            self.index["blocks"].append(self._block(np.concatenate(self.held)))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        self.index["ids"] = self._block(np.array([d or 0 for d in self.doc_ids], np.int64).view(np.uint64))
        self.index["known"] = self._block(known)
        self.index["lengths"] = self._block(np.array(self.lengths, np.uint64))
        self.index["n"] = int(sum(self.lengths))
        tail = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index).encode())
        self._put(tail + len(tail).to_bytes(8, "little") + MAGIC)
        return self.index["n"]


class PlaneReader:
    """Reads a file of PlaneWriter: any block, or all documents in order with one block in memory at a time."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file")
        size = int.from_bytes(tail[:8], "little")
        source.seek(end - 16 - size)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(source.read(size)))

    def _read(self, entry: dict, dtype: str) -> np.ndarray:
        self.source.seek(entry["at"])
        return unplaned([self.source.read(n) for n in entry["planes"]], entry["n"], dtype, self.index["bits"])

    def block(self, k: int) -> np.ndarray:
        return self._read(self.index["blocks"][k], "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        doc_ids = self._read(self.index["ids"], "<u8").view(np.int64).tolist()
        known = self._read(self.index["known"], "u1").tolist()
        held, k = np.zeros(0, "<u4"), 0
        for doc_id, there, n in zip(doc_ids, known, self._read(self.index["lengths"], "<u8").tolist(), strict=True):
            if n > len(held):
                more, got = [held], len(held)
                while got < n:
                    more.append(self.block(k))
                    got += len(more[-1])
                    k += 1
                held = np.concatenate(more)
            yield doc_id if there else None, held[:n]
            held = held[n:]


class WordIds:
    """Ids of whole texts from a tokenizers file, with the library asked once for each distinct word.

    That holds for vocabularies that compose, put white space to single spaces and lower-case, then split into words; texts with
    letters from U+0250 on (or U+0130) or with special tokens in them are given to the library as a whole.
    """

    #: Fixed value: the split of the vocabulary file; a file with another one is read by the library alone.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(spec)
        kinds = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"].get("Regex") for x in (config["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits == [self.SPLIT]
        # below U+0250 the standard library's classes can say the same, at twice the speed; superscripts and fractions are numbers there
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]+|_)+")
        self.whole = re.compile("[\x1c-\x1fİɐ-\U0010ffff]" + "".join("|" + re.escape(t["content"]) for t in config["added_tokens"]))
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or self.whole.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        found, words = self.split.findall(text.lower()), self.words
        try:
            return b"".join(map(words.__getitem__, found))
        except KeyError:
            if len(words) > CACHED_WORDS:
                words.clear()
            new = list(set(found).difference(words))
            for w, coded in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                words[w] = array("I", coded.ids).tobytes()
            return b"".join(map(words.__getitem__, found))


def word_ids(spec: str) -> WordIds:
    """The worker's coder for a vocabulary file's text, built once for each worker."""
    return kept_in_worker(f"word-ids:{hash(spec)}", lambda: WordIds(spec))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 2, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest (part, path, n_docs, n_ids), not yet run.

    Rows are dealt out by ranges of the id, ties by the text's hash; null ids come first. Null and empty texts have the end
    id alone; long texts are encoded whole; repeated rows are written each. `path` is a folder that all executors reach, with its scheme (without
    one: the local file system, for local sessions). An empty table writes no file or files without documents. Store the manifest once it has run: it names
    the files. Columns of the table besides id and text do not matter.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        coder, n_docs = word_ids(spec.value), 0
        with fs.open_output_stream(f"{folder}/{name}") as sink:
            writer = PlaneWriter(sink, bits)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(doc_id, np.frombuffer(coder.encode(text.as_py() or "") + end, "<u4"))
                    n_docs += 1
            n_ids = writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{path}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    )
    return dealt.mapInArrow(write, "part int, path string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """The documents of the manifest's files: doc_id, start (ids of all before it), n_tokens, ids_crc32 and, with keep_ids, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if keep_ids else None))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield told(rows)
                            rows = []
                    yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())))
        return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds[: 4 + keep_ids])})

    # one row per file: its number is that of the write's tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # few bytes but much to read: a number of tasks of its own, which Spark does not merge
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = starts.select("path", "start").repartition(tasks, "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))
