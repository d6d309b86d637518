"""Exact deduplication with a log-structured merge index of text digests.

A task's digests gather in a memtable of bounded size. A full memtable is sorted, equal digests are put together, and it is flushed as a run: one
row with its digests, identifiers and counts, its range, and a Bloom filter. Compaction cuts the sorted runs of all levels at the bounds of ranges of digests
and merges the slices of a range into one run of level 1, which keeps the smallest (or largest) identifier; nothing is sorted anew. A lookup reads the
runs whose range and filter admit the digest.

A digest met more than once is a hit. All hits fill one more Bloom filter of bounded size; the texts that pass it, and no others, are grouped byte by
byte, and these groups decide which texts are equal.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.shared import hot_keys, salted_join, scratch_path, staged

#: Entries of a memtable, and so of a run (a digest, 8 bytes of id, 8 of count and 2 of filter each).
MEMTABLE = 1 << 17
#: Bits of the filter of hits at most (16 MB); with more hits more texts pass it in vain.
HIT_BITS = 1 << 27
PROBES = 4
#: Dropped records up to this number (a digest and an id, some 60 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_GONE = 250_000
RUN = "run string, level int, bucket long, n long, width int, lo binary, hi binary, digests binary, ids binary, known binary, counts binary, filter binary"
ENTRY = "digest binary, keep_id long, n long"

Digest = Callable[[Column], Column]


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a filter (a power of two) that each digest (fixed-width bytes) sets: (digest, probe)."""
    width = digests.dtype.itemsize
    raw = np.zeros((len(digests), 16), np.uint8)
    raw[:, : min(width, 16)] = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)[:, :16]
    one, two = raw.view(np.uint64).T * np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)
    return ((one >> np.uint64(20))[:, None] + np.arange(PROBES, dtype=np.uint64) * (two >> np.uint64(20) | np.uint64(1))[:, None]) & np.uint64(bits - 1)


def filter_of(digests: np.ndarray) -> bytes:
    """A Bloom filter of 16 bits a digest or more."""
    bits = 1 << max(6, (16 * len(digests) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[places(digests, bits).ravel()] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def may_hold(filter_: bytes | np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which digests the filter admits."""
    held = np.frombuffer(filter_, np.uint8)
    at = places(digests, 8 * len(held))
    return ((held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def memtable(digests: np.ndarray, ids: np.ndarray, known: np.ndarray, counts: np.ndarray, keep: str) -> tuple[np.ndarray, ...]:
    """Sorted by digest, each once with the identifier to keep (unknown ones lose) and the sum of its counts."""
    order = np.lexsort((ids if keep == "min" else ~ids, ~known, digests))
    digests, ids, known, counts = (x[order] for x in (digests, ids, known, counts))
    first = np.nonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))[0] if len(digests) else np.zeros(0, np.int64)
    return digests[first], ids[first], known[first], np.add.reduceat(counts, first) if len(first) else counts


def _run_row(level: int, bucket: int, part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    digests, ids, known, counts = part
    width = digests.dtype.itemsize
    raw = digests.tobytes()
    values = (f"{uuid.uuid4().hex}", level, bucket, len(digests), width, raw[:width], raw[-width:], raw, ids.tobytes(), np.packbits(known).tobytes(), counts.tobytes(), filter_of(digests))
    schema = [(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in RUN.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, schema, strict=True)], schema=pa.schema(schema))


def _columns(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """Digests, ids, known and counts of (digest, keep_id, n) columns from `at` on. Digests have one width."""
    digests = batch.column(at).to_pylist()
    raw = np.frombuffer(b"".join(digests), f"S{len(digests[0])}")
    ids = batch.column(at + 1)
    return raw, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(at + 2).to_numpy()


def flushed(entries: DataFrame, keep: str) -> DataFrame:
    """Runs of level 0 of the entries (digest, keep_id, n), a memtable at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if n:
                yield _run_row(0, -1, memtable(*(np.concatenate(c) for c in zip(*held, strict=True)), keep))
            held, n = [], 0

        for batch in batches:
            columns, a = _columns(batch, 0) if batch.num_rows else (), 0
            while a < batch.num_rows:
                take = min(batch.num_rows - a, MEMTABLE - n)
                held.append(tuple(c[a : a + take] for c in columns))
                n, a = n + take, a + take
                if n == MEMTABLE:
                    yield from told()
        yield from told()

    return entries.mapInArrow(run, RUN)


def _told(digests: np.ndarray, ids: np.ndarray, known: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    width = digests.dtype.itemsize
    raw = digests.tobytes()
    return pa.RecordBatch.from_pydict({
        "digest": pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), "keep_id": pa.array(ids, pa.int64(), mask=~known), "n": pa.array(counts, pa.int64()),
    })


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    digests = np.frombuffer(row["digests"], f"S{row['width']}")
    return digests, np.frombuffer(row["ids"], np.int64), np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(digests)).astype(bool), np.frombuffer(row["counts"], np.int64)


def entries_of(runs: DataFrame, least: int = 1) -> DataFrame:
    """(digest, keep_id, n) of all entries of the runs with n of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _opened(batch.slice(i, 1).to_pylist()[0])
                chosen = part[3] >= least
                for at in range(0, len(chosen), 1 << 14):
                    own = slice(at, at + (1 << 14))
                    yield _told(*(c[own][chosen[own]] for c in part))

    return runs.select("width", "digests", "ids", "known", "counts").mapInArrow(run, ENTRY)


def ranges_of(digests: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each digest, in their order, when all digests are cut into so many."""
    width = digests.dtype.itemsize
    head = np.zeros((len(digests), 8), np.uint8)
    head[:, : min(width, 8)] = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)[:, :8]
    return ((head.view(">u8").ravel().astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merged_runs(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], keep: str) -> tuple[np.ndarray, ...]:
    """Two sorted runs as one: entries of equal digests are put together, others go to their places; nothing is sorted anew."""
    digests, ids, known, counts = (x.copy() for x in one)
    at = np.searchsorted(digests, two[0])
    same = np.zeros(len(two[0]), bool)
    inside = at < len(digests)
    same[inside] = digests[at[inside]] == two[0][inside]
    to, other = at[same], tuple(x[same] for x in two)
    better = other[2] & (~known[to] | (other[1] < ids[to] if keep == "min" else other[1] > ids[to]))
    ids[to] = np.where(better, other[1], ids[to])
    known[to] |= other[2]
    counts[to] += other[3]
    return tuple(np.insert(x, at[~same], y[~same]) for x, y in zip((digests, ids, known, counts), two, strict=True))


SLICE = "bucket long, width int, digests binary, ids binary, known binary, counts binary"


def slices(runs: DataFrame, buckets: int) -> DataFrame:
    """The runs cut at the bounds of the digests' ranges; a run has slices in the ranges that its own range meets, and only these move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = _opened(row)
                bucket = ranges_of(part[0], buckets)
                cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(bucket)]
                own = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(bucket) else []
                out = {"bucket": pa.array([int(bucket[a]) for a, _ in own], pa.int64()), "width": pa.array([row["width"]] * len(own), pa.int32())}
                for name, column in zip(("digests", "ids", "known", "counts"), part, strict=True):
                    out[name] = pa.array([column[a:b].tobytes() for a, b in own], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return runs.select("width", "digests", "ids", "known", "counts").mapInArrow(run, SLICE)


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """Level 1: the runs of all levels merged, one run for each range of digests, of about a memtable. Slices of a range are merged two by two, the shortest first."""
    n = runs.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n // MEMTABLE))

    def run(table: pa.Table) -> pa.Table:
        kinds = (f"S{table['width'][0].as_py()}", np.int64, bool, np.int64)
        columns = (table[c].to_pylist() for c in ("digests", "ids", "known", "counts"))
        waiting = [(len(part[0]), i, part) for i, part in enumerate(tuple(np.frombuffer(x, kind) for x, kind in zip(row, kinds, strict=True)) for row in zip(*columns, strict=True))]
        heapq.heapify(waiting)
        while len(waiting) > 1:
            (_, i, one), (_, _, two) = heapq.heappop(waiting), heapq.heappop(waiting)
            both = merged_runs(two, one, keep)
            heapq.heappush(waiting, (len(both[0]), i, both))
        return pa.Table.from_batches([_run_row(1, table["bucket"][0].as_py(), waiting[0][2])])

    return slices(runs, buckets).groupBy("bucket").applyInArrow(run, RUN)


def hit_filter(hits: DataFrame, bits: int = HIT_BITS) -> np.ndarray:
    """The Bloom filter of the digests (column digest), 16 bits each but `bits` at most; only its words reach the driver."""
    size = min(bits, 1 << max(6, (16 * hits.count() - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            at = places(np.frombuffer(b"".join(found), f"S{len(found[0])}"), size).ravel() if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    words = hits.select("digest").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def exact_groups(docs: DataFrame, keep: str = "min", digest: Digest = sha256_digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are, whole; a null text counts as empty. Of equal texts the row with the smallest (keep='max': largest) id is
    kept; rows that repeat the kept id are all marked kept; null ids lose to any other. Equal digests of different texts are told apart by the
    texts. Ids are whole numbers. An empty table gives no rows. Columns of the table besides id and text do not matter.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    sha = F.lower(F.hex("digest")) if digest is sha256_digest else F.sha2("body", 256)
    rows = staged(whole.withColumn("digest", digest(F.col("body"))).select("doc_id", "digest", sha.alias("text_sha256")), "digest-rows")
    index = MergeIndex(spark, scratch_path(spark, "digest-index"), keep, digest)
    index.flush(rows)
    index.compact()
    hits = staged(index.entries(least=2), "digest-hits")
    sent = spark.sparkContext.broadcast(hit_filter(hits))

    @F.pandas_udf("boolean")
    def maybe(digests: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, np.frombuffer(b"".join(digests), f"S{len(digests.iloc[0])}")) if len(digests) else [], dtype=bool)

    # byte verification: equal texts collapse in each task before they move
    pick = F.min("doc_id") if keep == "min" else F.max("doc_id")
    passed = whole.withColumn("digest", digest(F.col("body"))).where(maybe("digest"))
    verified = staged(passed.groupBy("digest", "body").agg(pick.alias("keep_id"), F.count("*").alias("n")), "digest-verified")
    shapes = verified.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    shapes = staged(shapes, "digest-texts")
    marked = staged(rows.withColumn("maybe", maybe("digest")), "digest-marked")
    columns = ["doc_id", "keep_id", "n", "text_sha256"]
    alone = marked.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "text_sha256")
    one_text = shapes.where("texts = 1").select("digest", "keep_id", "n")
    grouped = salted_join(marked.where("maybe").drop("maybe"), one_text, "digest", "doc_id", hot_keys(shapes, "digest", "n")).select(*columns)
    found = alone.unionByName(grouped)
    collided = shapes.where("texts > 1").select("digest")
    if collided.count():  # several texts of one digest: rows go to the group of their own text
        again = passed.join(collided, "digest", "left_semi")
        found = found.unionByName(again.join(verified, ["digest", "body"]).select("doc_id", "keep_id", "n", F.sha2("body", 256).alias("text_sha256")))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The documents without exact copies, all columns as they are.

    Null and empty texts are copies of each other. Rows that repeat both the kept id and its text are the same record and stay as they are;
    rows without an id stay only where no equal text has one. Long texts are compared whole. An empty table stays empty.
    """
    gone = staged(
        exact_groups(docs, keep).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_text")).distinct(),
        "dedup-gone",
    )
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (sha256_digest(F.coalesce(docs["text"], F.lit(""))) == gone["gone_text"])
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone, same, "left_anti")


class MergeIndex:
    """A stored index that documents are added to batch by batch; runs are rows of Parquet folders under a path.

    A folder that a failed job left without its success mark is not read. Folders are numbered; a merged one stands for all that were there before it,
    which are then removed. So a driver that dies between the two steps counts nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "min", digest: Digest = sha256_digest):
        self.spark, self.path, self.keep, self.digest = spark, path, keep, digest

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[str]:
        """The folders to read: finished, and of the newest generation or added since."""
        pattern, fs = self._fs(f"{self.path}/*/_SUCCESS")
        names = sorted(x.getPath().getParent().getName() for x in fs.globStatus(pattern) or [])
        merged_at = max((n for n in names if n.startswith("merged-")), default=None, key=lambda n: int(n.split("-")[1]))
        if merged_at is None:
            return [f"{self.path}/{n}" for n in names]
        generation = int(merged_at.split("-")[1])
        return [f"{self.path}/{n}" for n in names if n == merged_at or n.startswith("batch-") and int(n.split("-")[1]) > generation]

    def _next(self) -> int:
        pattern, fs = self._fs(f"{self.path}/*")
        return 1 + max((int(x.getPath().getName().split("-")[1]) for x in fs.globStatus(pattern) or []), default=0)

    def runs(self) -> DataFrame:
        found = self._runs()
        return self.spark.read.schema(RUN).parquet(*found) if found else self.spark.createDataFrame([], RUN)

    def flush(self, rows: DataFrame) -> None:
        """Add rows (doc_id, digest) as runs of level 0."""
        entries = rows.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        flushed(entries, self.keep).write.parquet(f"{self.path}/batch-{self._next()}-{uuid.uuid4().hex}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush the documents' digests as runs."""
        self.flush(docs.select(F.col(id_col).alias("doc_id"), self.digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")))

    def compact(self) -> None:
        """Merge all runs into runs of level 1, then remove those merged."""
        old = self._runs()
        if not old:
            return
        merged(self.runs(), self.keep).write.parquet(f"{self.path}/merged-{self._next()}-{uuid.uuid4().hex}")
        for run in old:
            folder, fs = self._fs(run)
            fs.delete(folder, True)

    def entries(self, least: int = 1) -> DataFrame:
        """The runs' entries with n of `least` or more; after a compaction a digest is in one run."""
        return entries_of(self.runs(), least)

    def table(self) -> DataFrame:
        """(digest, keep_id, n) over all runs."""
        pick = F.min("keep_id") if self.keep == "min" else F.max("keep_id")
        return self.entries().groupBy("digest").agg(pick.alias("keep_id"), F.sum("n").alias("n"))

    def lookup(self, text: str) -> DataFrame:
        """(keep_id, n) of texts with this text's digest, however often it was added; runs whose range or filter lacks it are not opened."""
        wanted = bytes(self.spark.range(1).select(self.digest(F.lit(text)).alias("d")).first()["d"])
        near = self.runs().where((F.col("lo") <= F.lit(wanted)) & (F.col("hi") >= F.lit(wanted)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = np.array([wanted], f"S{len(wanted)}")
            for batch in batches:
                for row in batch.to_pylist():
                    if may_hold(row["filter"], key)[0]:
                        part = _opened(row)
                        at = int(np.searchsorted(part[0], key[0]))
                        if at < len(part[0]) and part[0][at] == key[0]:
                            yield _told(*(c[at : at + 1] for c in part))

        found = near.mapInArrow(run, ENTRY)
        pick = F.min("keep_id") if self.keep == "min" else F.max("keep_id")
        return found.groupBy("digest").agg(pick.alias("keep_id"), F.sum("n").alias("n")).select("keep_id", "n")

    def seen(self, docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Documents whose text is in the indexed corpus: doc_id, keep_id. Hits are compared byte by byte with the kept document's text.

        Null texts are empty ones. Texts kept without an id are not found; repeated documents are told once.
        """
        new = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        hits = new.withColumn("digest", self.digest(F.col("body"))).join(self.table(), "digest")
        held = corpus.select(F.col(id_col).alias("keep_id"), F.coalesce(F.col(text_col), F.lit("")).alias("held"))
        return hits.join(held, "keep_id").where("body = held").select("doc_id", "keep_id").distinct()
