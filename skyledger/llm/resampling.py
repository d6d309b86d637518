"""Importance resampling towards a target distribution, by hashed word n-grams.

Every run of one to so many words falls into a bucket. The documents and the target texts are counted bucket by bucket, which gives a gain for each; a
document's weight is the mean of its features' gains, read from one array. A Gumbel number drawn from a hash of the id is added, so that
the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The draw is a merge sort. Every task sorts its eligible rows: a run. Cuts from a random sample of the runs' rows split the one order of all rows (score,
id, place) into ranges of about as many rows each, whatever the ties; counts of the ranges give each its first rank. Only ranges that begin
before the last rank are shuffled. A range is merged by a tournament tree over the runs' slices, which ends at the exact count. Undrawn ranges never move.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import dealt_out, let_go, map_batches, staged
from skyledger.operators.order import with_position

BUCKETS, RUN_WORDS = 10_000, 2
#: Rows of a range on average; at most so many ranges are cut, larger ones beyond (32 bytes a cut are broadcast).
RANGE_ROWS, MOST_RANGES, SAMPLES_PER_RANGE = 8192, 1 << 17, 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters a-z, digits and every byte of a character beyond ASCII make words; A-Z count as small letters.
_WORD_BYTES = bytes(_LOWER[c] if chr(_LOWER[c]).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at a time.
CHUNK = 1 << 20


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The text's words in lists; words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    data = (text or "").encode("utf-8", "replace").translate(_WORD_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + CHUNK)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end + 1


def feature_buckets(text: str | None, longest: int = RUN_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to `longest` consecutive words, repeats included, and the number of words."""
    crc, spaced = zlib.crc32, b" ".__add__
    found, n = [], 0
    before: list[list[int]] = [[] for _ in range(longest - 1)]  # the last word's runs of 1, 2, ... words
    for words in words_of(text):
        if not words:
            continue
        n += len(words)
        joined = list(map(spaced, words))
        ends = list(map(crc, words))
        found.append(np.array(ends, np.int64))
        for size in range(longest - 1):  # a run goes on from the crc of the run one word shorter that ended before
            last, before[size] = before[size], ends[-1:]
            starts = last + ends[:-1]
            ends = list(map(crc, joined[len(joined) - len(starts) :], starts))
            found.append(np.array(ends, np.int64))
    return (np.concatenate(found) % buckets if found else np.zeros(0, np.int64)), n


def bucket_counts(texts: DataFrame, longest: int = RUN_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) fall into each bucket. Tasks send one row for each bucket that they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(feature_buckets(text.as_py(), longest, buckets)[0], minlength=buckets)
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"bucket": met.astype(np.int32), "n": total[met]})

    counts = np.zeros(buckets, np.int64)
    for r in dealt_out(texts.select("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored 1000-fold logarithm of the target's share over the source's, each bucket counted once more."""
    all_source, all_target = int(source.sum()) + len(source), int(target.sum()) + len(target)
    # whole products are exact in Python; one division in doubles follows
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """The floored 1000-fold Gumbel number of the first 32 bits of sha256('<seed>:<doc_id>'); a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def rows(batch: pa.RecordBatch) -> dict:
        values, out = sent.value, ([], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, n = feature_buckets(text.as_py(), longest, len(values))
            weight = int(values[found].sum()) // len(found) if len(found) else 0
            for column, value in zip(out, (n, len(found), weight, weight + gumbel(doc_id, seed)), strict=True):
                column.append(value)
        return {"doc_id": batch.column(0)} | {c: pa.array(v, pa.int64()) for c, v in zip(("n_words", "n_features", "weight", "score"), out, strict=True)}

    slim = dealt_out(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return map_batches(slim, rows, "doc_id long, n_words long, n_features long, weight long, score long")


#: A row's place in the one order of all: smaller comes first. No two rows are equal, as `at` is a row's own number.
ORDER = ("down", "none", "id", "at")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))


def ranges_of(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """For every row the number of cuts (ascending) at or before it. Columns of both in the order of ORDER."""
    low, high = np.searchsorted(cuts[0], keys[0], "left"), np.searchsorted(cuts[0], keys[0], "right")
    unsure = np.nonzero(low < high)[0]
    if len(unsure):
        tuples = list(zip(*(c.tolist() for c in cuts), strict=True))
        for i in unsure.tolist():
            row, a, b = tuple(int(k[i]) for k in keys), int(low[i]), int(high[i])
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if tuples[mid] <= row else (a, mid)
            high[i] = a
    return high


class Tournament:
    """A tree of losers over sorted runs of tuples: the least head wins, and its run plays again from its leaf upward."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.size - len(self.runs))
        self.losers = [0] * self.size
        winners = list(range(self.size))
        level = self.size
        while level > 1:  # leaves play pairwise, winners go up
            level //= 2
            following = []
            for i in range(level):
                a, b = winners[2 * i], winners[2 * i + 1]
                won, lost = (a, b) if self._before(a, b) else (b, a)
                self.losers[level + i] = lost
                following.append(won)
            winners = following
        self.winner = winners[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x <= y

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            won = self.winner
            self.heads[won] = next(self.runs[won], None)
            node = (self.size + won) // 2
            while node:
                if not self._before(won, self.losers[node]):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def _cuts(runs: DataFrame, rows: int, range_rows: int) -> list[np.ndarray]:
    """Cuts of the order into ranges of about range_rows rows, from a random sample of the rows."""
    wanted = min(MOST_RANGES, rows // range_rows)
    if wanted < 1:
        return [np.zeros(0, np.int64) for _ in ORDER]
    every = max(1, rows // (wanted * SAMPLES_PER_RANGE))
    sample = staged(runs.where(F.pmod(F.xxhash64("at"), F.lit(every)) == 0).select(*ORDER), "draw-sample")
    ranked = with_position(sample, *ORDER)
    chosen = ranked.where(F.col("pos") % SAMPLES_PER_RANGE == SAMPLES_PER_RANGE - 1).select(*ORDER).toArrow()  # MOST_RANGES rows or so at most
    columns = [chosen[c].to_numpy() for c in ORDER]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = RUN_WORDS, buckets: int = BUCKETS, range_rows: int = RANGE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for rows that are not drawn.

    Of the N rows with at least `least_words` words, the floor(percent * N / 100) highest scores are drawn, ties to the smaller id, and ranked from 1. Null, empty
    and wordless texts have no features and weight 0; so has everything if both tables are empty of words. Whole texts are read, however
    long. A null id is written as nothing in the hash and loses ties. Rows that share an id are documents of their own; rows that are
    the same in all respects get ranks next to each other. An empty table gives no rows; an empty target only makes common features weigh less.
    Other columns do not matter.
    """
    gain = gains(bucket_counts(docs.select(F.col(text_col).alias("text")), longest, buckets), bucket_counts(target.select(F.col(target_text).alias("text")), longest, buckets))
    rows = _keyed(scored(docs, gain, seed, longest, id_col, text_col))
    # a run: what a task has, in order; it is written once, so `at` names a row for good
    runs = staged(rows.sortWithinPartitions("down", "none", "id").withColumn("at", F.monotonically_increasing_id()), "draw-runs")
    eligible = runs.where(F.col("n_words") >= least_words)
    n = eligible.count()
    drawn = percent * n // 100
    sent = docs.sparkSession.sparkContext.broadcast(_cuts(eligible, n, range_rows))

    def placed(batch: pa.RecordBatch) -> dict:
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ORDER]
        return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"range": pa.array(ranges_of(keys, sent.value), pa.int64())}

    kept = ("doc_id", "n_features", "weight", *ORDER)
    ranged = staged(map_batches(eligible.select(*kept), placed, "doc_id long, n_features long, weight long, down long, none long, id long, at long, range long"), "draw-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = staged(ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "draw-sizes")
    met = ranged.join(F.broadcast(sizes.select("range", "first")), "range")

    def merged(table: pa.Table) -> pa.Table:
        let_go()
        first = table["first"][0].as_py()
        columns = [table[c].to_numpy() for c in ORDER]
        by_run = np.argsort(columns[-1], kind="stable")  # a run's rows are in order of `at`
        run_of = columns[-1][by_run] >> 33
        starts = np.nonzero(np.diff(run_of, prepend=-1))[0].tolist() + [len(run_of)]
        lists = [c[by_run].tolist() for c in columns]
        own = by_run.tolist()
        slices = [zip(*(c[a:b] for c in lists), own[a:b], strict=True) for a, b in zip(starts, starts[1:], strict=False)]
        rank = np.zeros(len(own), np.int64)
        for place, row in enumerate(Tournament(slices), first + 1):
            if place > drawn:
                break
            rank[row[-1]] = place
        out = {c: table[c] for c in ("doc_id", "n_features", "weight")} | {"score": pa.array(-columns[0])}
        return pa.table(out | {"rank": pa.array(rank, pa.int64(), mask=rank == 0)})

    schema = "doc_id long, n_features long, weight long, score long, rank long"
    winners = met.where(F.col("first") < drawn).groupBy("range").applyInArrow(merged, schema)
    undrawn = met.where(F.col("first") >= drawn).select("doc_id", "n_features", "weight", (-F.col("down")).alias("score"))
    short = runs.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score")
    return winners.unionByName(undrawn.unionByName(short).withColumn("rank", F.lit(None).cast("long")))
