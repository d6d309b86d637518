"""Exact top-k inner products with a bit-sliced index.

Vectors are dealt into blocks. A block keeps, for every dimension, the top bits of the (shifted) components as slices: bitmaps with one bit per
row. For a query the slices are added up with bitmap arithmetic (carry-save adders over whole slices, then one ripple),
weighted by the top bits of the query's components, which gives a coarse score in slices again. The k-th best coarse score is found
from the most significant slice downward. Rows that the bits left out could still lift over it (a bound on the error tells) are the
boundary rows: their integer inner products are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import staged

#: Rows of an index block, queries of a query block, bits kept of a component and of a query's component.
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 64
COMPONENT_BITS = 7
QUERY_BITS = 6
#: Query blocks of a lane at most (about 8 kB each).
LANE = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and the components times scale, rounded down; without vectors that are null, empty or hold null, NaN or infinity."""
    v = F.col(vector_col)
    number = F.transform(v, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.col(id_col).isNotNull()
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(number, lambda x: F.floor(x * scale)).alias("x"))


def index_blocks(rows: DataFrame) -> DataFrame:
    """(block, dim, width, ids, x): up to BLOCK_ROWS vectors of one length as they come in a task, in numbers of `width` bytes."""
    return _blocked(rows, BLOCK_ROWS)


def _blocked(rows: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            made += 1
            kind = np.int16 if -(1 << 15) <= x.min() and x.max() < 1 << 15 else np.int64
            row = {"block": pa.array([(part << 32) + made], pa.int64()), "dim": pa.array([dim], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32())}
            return pa.RecordBatch.from_pydict(row | {"ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.astype(kind).tobytes()], pa.binary())})

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                which = np.nonzero(sizes == dim)[0]
                x = flat[starts[which][:, None] + np.arange(dim)]
                at = 0
                while at < len(which):
                    there = sum(len(i) for i, _ in held.get(dim, []))
                    take = min(most - there, len(which) - at)
                    held.setdefault(dim, []).append((ids[which[at : at + take]], x[at : at + take]))
                    at += take
                    if there + take == most:
                        yield told(dim)
        for dim in list(held):
            yield told(dim)

    return rows.mapInArrow(run, "block long, dim int, width int, ids binary, x binary")


def _vectors(x: bytes, dim: int, width: int) -> np.ndarray:
    return np.frombuffer(x, f"i{width}").reshape(-1, dim)


class SlicedBlock:
    """A block's slices and its exact components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, dim = x.shape
        raised = x.astype(np.int64) - int(x.min())
        self.drop = max(0, int(raised.max()).bit_length() - COMPONENT_BITS)
        top = raised >> self.drop
        left_out = raised - (top << self.drop) - ((1 << self.drop) - 1) / 2
        spread = raised - raised.mean(0)
        self.left_out = float(np.sqrt((left_out**2).sum(1)).max())
        self.spread = float(np.sqrt((spread**2).sum(1)).max())
        self.words = (n + 63) // 64
        bits = np.zeros((dim, COMPONENT_BITS, self.words * 64), np.uint8)
        for b in range(COMPONENT_BITS):
            bits[:, b, :n] = ((top >> b) & 1).T
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.there = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def coarse(self, weights: np.ndarray, negative: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of the weighted sum of the top bits; of their complement where negative."""
        height = COMPONENT_BITS + QUERY_BITS + int(len(weights)).bit_length() + 1
        total = np.zeros((height, self.words), np.uint64)
        for bit in range(int(weights.max()).bit_length() - 1, -1, -1):
            total[1:] = total[:-1].copy()  # twice what the higher bits gave
            total[0] = 0
            chosen = np.nonzero((weights >> bit) & 1)[0]
            if not len(chosen):
                continue
            tall = COMPONENT_BITS + int(len(chosen)).bit_length() + 1
            sums, carries, addend = (np.zeros((tall, self.words), np.uint64) for _ in range(3))
            t, both = np.empty_like(sums), np.empty_like(sums)
            for d in chosen.tolist():
                np.invert(self.slices[d], out=addend[:COMPONENT_BITS]) if negative[d] else np.copyto(addend[:COMPONENT_BITS], self.slices[d])
                np.bitwise_xor(sums, carries, out=t)
                np.bitwise_and(sums, carries, out=both)
                np.bitwise_xor(t, addend, out=sums)
                np.bitwise_and(t, addend, out=t)
                np.bitwise_or(both[:-1], t[:-1], out=carries[1:])
            _add(total, sums)
            _add(total, carries)
        return total

    def candidates(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Numbers of the rows that can be among the k best, without those marked in `own`."""
        size = np.abs(query)
        shift = max(0, int(size.max()).bit_length() - QUERY_BITS)
        weights = size >> shift
        there = self.there & ~np.packbits(np.pad(own, (0, self.words * 64 - len(own))), bitorder="little").view(np.uint64)
        if not weights.any() or int(np.bitwise_count(there).sum()) <= k:
            return _numbers(there)
        signed = np.where(query < 0, -weights, weights) << shift
        error = np.sqrt((signed.astype(float) ** 2).sum()) * self.left_out + np.sqrt(((query - signed).astype(float) ** 2).sum()) * self.spread
        slices = self.coarse(weights, query < 0)
        floor = _kth(slices, there, k) - int(2 * error / (1 << (self.drop + shift))) - 2
        return _numbers(_at_least(slices, there, max(floor, 0)))

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows, ties to the smaller id; rows with the query's id take no part."""
        rows = self.candidates(query, k, self.ids == query_id)
        scores, ids = self.x[rows].astype(np.int64) @ query, self.ids[rows]
        order = np.lexsort((ids, -scores))[:k]
        return list(zip(ids[order].tolist(), scores[order].tolist(), strict=True))


def _add(total: np.ndarray, more: np.ndarray) -> None:
    """Ripple addition of slices in place."""
    carry = np.zeros_like(total[0])
    for i in range(len(total)):
        if i < len(more):
            half = total[i] ^ more[i]
            kept = total[i] & more[i] | half & carry
            total[i] = half ^ carry
        else:
            kept = total[i] & carry
            total[i] ^= carry
        carry = kept


def _kth(slices: np.ndarray, rows: np.ndarray, k: int) -> int:
    """The k-th highest value among the rows of a bitmap, bit by bit from the top."""
    equal, above, value = rows.copy(), 0, 0
    for i in range(len(slices) - 1, -1, -1):
        ones = equal & slices[i]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | 1 << i
        else:
            above += n
            equal &= ~slices[i]
    return value


def _at_least(slices: np.ndarray, rows: np.ndarray, value: int) -> np.ndarray:
    equal, more = rows.copy(), np.zeros_like(rows)
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            equal &= slices[i]
        else:
            more |= equal & slices[i]
            equal &= ~slices[i]
    return more | equal


def _numbers(rows: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))[0]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row, ties to the smaller vec_id.

    `is_query` is a condition on vec_id. Vectors that are null or empty, hold null or non-finite components, or have a null id take no
    part; vectors meet only those of the same length. Rows that share the query's id count as its own and are no candidates. Repeated
    query rows count once; other repeated rows are candidates each. Components times scale must lie below 2**25 or so, else sums may overflow. An
    empty table gives no rows. Columns of the table besides id and vector do not matter.
    """
    rows = usable(vectors, id_col, vector_col, scale)
    # few large blocks make long bitmaps; the number of tasks follows the number of rows
    n = vectors.count()
    blocks = staged(_blocked(rows.coalesce(max(1, -(-n // BLOCK_ROWS))), BLOCK_ROWS), "index-blocks")
    asked = staged(_blocked(rows.where(is_query).dropDuplicates(), QUERY_ROWS), "query-blocks")
    spread = max(1, blocks.count())  # as many buckets as blocks, so that a task holds a few blocks at any size
    # few bytes but much work: as many tasks as the session has shuffle partitions; while there are fewer blocks than tasks,
    # blocks are sent to several lanes and each lane has a share of the queries, a bounded one at any size
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, tasks // spread, -(-asked.count() // LANE))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    placed = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(spread)).alias("bucket"), upto(lanes).alias("lane"))
    sent = asked.select("dim", "width", "ids", "x", F.pmod(F.xxhash64("block"), F.lit(lanes)).alias("lane"), upto(spread).alias("bucket"))

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        for ids, x, dim, width in zip(*(index[c].to_pylist() for c in ("ids", "x", "dim", "width")), strict=True):
            block = SlicedBlock(np.frombuffer(ids, np.int64), _vectors(x, dim, width))
            for q_ids, q_x, q_width in zip(*(queries[c].to_pylist() for c in ("ids", "x", "width")), strict=True):
                for q, query in zip(np.frombuffer(q_ids, np.int64).tolist(), _vectors(q_x, dim, q_width).astype(np.int64), strict=True):
                    key = xxhash.xxh64_intdigest(query.tobytes()) >> 1
                    found += [(q, key, v, s) for v, s in block.best(q, query, k)]
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "query_key", "vec_id", "score"))})

    # an index block is sent once to each of its lanes, and the lane's queries go past it there
    key = ["dim", "bucket", "lane"]
    found = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
