"""Hard negatives by blocked dense products.

Rows are written once as blocks: up to 1024 vectors of one length, whole numbers in as few bytes as hold them. Anchor blocks are broadcast, a bounded
number of bytes at a time, and every candidate block is multiplied by them in float64, in which whole numbers below 2^53 are exact. A task keeps the
best scores of every anchor it has met; what tasks kept is merged by one ranked window. The first pass over the candidates finds an anchor's
positives, which open its windows of scores; the second finds the best negatives within each window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.shared import dealt_out, let_go, staged
from skyledger.operators.order import with_position

#: Vectors of a block at most; bytes of anchors, as float64, that are broadcast at once (one block at least).
BLOCK_ROWS, ANCHOR_BYTES = 1024, 16 << 20
#: Scores and 1024 times scores are exact below these; larger ones are added up as Python's whole numbers.
EXACT, LEAST = 1 << 52, -(1 << 63) + 1
FIELDS = "dim int, width int, ids binary, labels binary, x binary"


class Block(NamedTuple):
    first: int
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    top: int


def usable_labelled(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and the components times scale, rounded down; without rows that hold null or a component that is null or not finite."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("x"))


def blocked(rows: DataFrame) -> DataFrame:
    """Blocks of the rows (vec_id, label, x) as they come in a task; a block is in order of vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat, starts = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                which = np.nonzero(sizes == dim)[0]
                which = which[np.argsort(ids[which], kind="stable")]
                for at in range(0, len(which), BLOCK_ROWS):
                    own = which[at : at + BLOCK_ROWS]
                    x = flat[starts[own][:, None] + np.arange(dim)]
                    kind = np.int16 if -(1 << 15) <= x.min() and x.max() < 1 << 15 else np.int64
                    row = {"dim": pa.array([dim], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32())}
                    for name, values in (("ids", ids[own]), ("labels", labels[own]), ("x", x.astype(kind))):
                        row[name] = pa.array([values.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_pydict(row)

    return rows.mapInArrow(run, FIELDS)


def _block(first: int, dim: int, width: int, ids: bytes, labels: bytes, x: bytes) -> Block:
    values = np.frombuffer(x, f"i{width}").reshape(-1, dim)
    top = max(int(values.max()), -int(values.min()))
    return Block(first, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), values.astype(np.float64) if top < 1 << 53 else values.astype(object), top)


def products(a: Block, b: Block, rows: np.ndarray | slice = slice(None), columns: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Exact inner products of rows of a and rows of b: float64 where all are below EXACT, else Python's numbers, held within 64 bits."""
    x, y = a.x[rows], b.x[columns]
    if a.top * b.top * x.shape[1] < EXACT:
        return x @ y.T
    whole = lambda v: np.array([[int(c) for c in row] for row in v], object).reshape(v.shape)
    found = whole(x) @ whole(y).T
    return np.minimum(np.maximum(found, LEAST + 1), -LEAST)


class Best:
    """The k best (score, id) of every row, higher scores first, ties by smaller id; two of them merge."""

    def __init__(self, rows: int, k: int):
        self.scores, self.ids = np.full((rows, k), LEAST, np.int64), np.full((rows, k), np.iinfo(np.int64).max, np.int64)

    def least(self) -> np.ndarray:
        return self.scores[:, -1:]

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take more (score, id) for these rows; a score of LEAST stands for none."""
        both, names = np.concatenate([self.scores[rows], scores], 1), np.concatenate([self.ids[rows], ids], 1)
        order = np.lexsort((names, -both), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def offer(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Take the scores (one row for each of `rows`, columns in order of ids) that are allowed and good enough."""
        allowed = allowed & (scores >= self.least()[rows])
        some = np.nonzero(allowed.any(1))[0]
        if not len(some):
            return
        n, k = len(ids), self.scores.shape[1]
        if scores.dtype == object:
            for i in some.tolist():
                found = sorted(((-int(scores[i, j]), int(ids[j])) for j in np.nonzero(allowed[i])[0]))[:k]
                self.merge(rows[i : i + 1], np.array([[-s for s, _ in found]], np.int64), np.array([[v for _, v in found]], np.int64))
            return
        # a score and its column in one number, so that no two are equal and ties fall to the smaller id
        keys = np.where(allowed[some], scores[some].astype(np.int64) * BLOCK_ROWS + np.arange(BLOCK_ROWS - 1, BLOCK_ROWS - 1 - n, -1), LEAST)
        if n > k:
            keys = np.partition(keys, n - k, axis=1)[:, n - k :]
        there = keys > LEAST
        self.merge(rows[some], np.where(there, keys >> 10, LEAST), np.where(there, ids[np.where(there, BLOCK_ROWS - 1 - (keys & BLOCK_ROWS - 1), 0)], np.iinfo(np.int64).max))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _block(0, *row)


def _rank(found: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(best)).where(F.col(name) <= k)


def _positives(candidates: DataFrame, anchors, k: int) -> DataFrame:
    """(anchor, anchor_id, vec_id, score, place): the k best other rows with the anchor's label; anchor is its number, place its rank from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        best = {a.first: Best(len(a.ids), k) for a in anchors.value}
        for b in _candidates(batches):
            groups = {label: np.nonzero(b.labels == label)[0] for label in np.unique(b.labels).tolist()}
            for a in anchors.value:
                if a.x.shape[1] != b.x.shape[1]:
                    continue
                for label in np.unique(a.labels).tolist():
                    if label in groups:
                        rows, columns = np.nonzero(a.labels == label)[0], groups[label]
                        ids = b.ids[columns]
                        other = np.ones((len(rows), len(columns)), bool)
                        for i in np.nonzero(np.isin(a.ids[rows], ids))[0].tolist():
                            other[i] = ids != a.ids[rows[i]]
                        best[a.first].offer(rows, products(a, b, rows, columns), other, ids)
        for a in anchors.value:
            found = best[a.first]
            row, at = np.nonzero(found.scores > LEAST)
            if len(row):
                yield pa.RecordBatch.from_pydict({"anchor": a.first + row, "anchor_id": a.ids[row], "vec_id": found.ids[row, at], "score": found.scores[row, at]})

    return _rank(candidates.mapInArrow(run, "anchor long, anchor_id long, vec_id long, score long"), ["anchor"], k, "place")


def _negatives(candidates: DataFrame, anchors, positives, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of other labels in the window of each anchor's positive. positives: anchor number -> its (place, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        wanted = []
        for a in anchors.value:
            scores, ids = positives.value[a.first]
            for place in range(scores.shape[1]):
                rows = np.nonzero(scores[:, place] > LEAST)[0]
                if len(rows):
                    own = scores[rows, place].tolist()
                    floor, roof = [-(-low * s // 100) for s in own], [high * s // 100 for s in own]
                    bound = lambda v: np.array([min(max(s, LEAST + 1), -LEAST) for s in v], np.int64)[:, None]
                    wanted.append((a, place, rows, bound(floor), bound(roof), Best(len(a.ids), k)))
        for b in _candidates(batches):
            held, scores = None, None
            for a, _, rows, floor, roof, best in wanted:
                if a.x.shape[1] != b.x.shape[1]:
                    continue
                if held is not a:
                    held, scores, differ = a, products(a, b), a.labels[:, None] != b.labels[None, :]
                own = scores[rows]
                best.offer(rows, own, differ[rows] & (own >= floor) & (own <= roof), b.ids)
        for a, place, rows, _, _, best in wanted:
            row, at = np.nonzero(best.scores > LEAST)
            if len(row):
                scores, ids = positives.value[a.first]
                yield pa.RecordBatch.from_pydict({
                    "anchor": a.first + row, "place": np.full(len(row), place + 1, np.int32), "anchor_id": a.ids[row], "positive_id": ids[row, place],
                    "positive_score": scores[row, place], "vec_id": best.ids[row, at], "score": best.scores[row, at],
                })

    kinds = "anchor long, place int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    return _rank(candidates.mapInArrow(run, kinds), ["anchor", "place"], k, "rank")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, anchor_bytes: int = ANCHOR_BYTES,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its positives, the best negatives.

    `is_anchor` is a condition on vec_id. A row's score is the integer inner product, components times `scale` rounded down; higher first, ties by smaller
    vec_id. Positives: the first `positives` other rows of the anchor's label. Negatives: the first `negatives` rows of other labels whose score lies
    within low and high per cent of the positive's. Fewer, or none, where there are not so many.

    Rows with a null id, label or vector, an empty vector, or a component that is null or not finite take no part; vectors meet only those of the same
    length. Rows that share the anchor's id count as its own and are no positives. Repeated anchors count once; other repeated rows are
    candidates each. Scores that 64 bits do not hold are taken for the nearest that they do. An empty table, or one without anchors, gives no rows.
    Other columns do not matter, and there is no text.
    """
    spark = vectors.sparkSession
    rows = usable_labelled(vectors, scale, id_col, label_col, vector_col)
    candidates = staged(blocked(dealt_out(rows)), "negative-blocks")
    asked = staged(blocked(rows.where(is_anchor).distinct()).withColumn("block", F.monotonically_increasing_id()), "anchor-blocks")
    n, largest = asked.agg(F.count("*"), F.max(F.length("x") / F.col("width") * 8)).first()
    at_once = max(1, int(anchor_bytes // (largest or 1)))
    placed = with_position(asked, "block") if n > at_once else asked.withColumn("pos", F.lit(0).cast("long"))
    parts = []
    for start in range(0, max(n, 1), at_once):
        # so many blocks that anchor_bytes hold them
        held = [_block(r["pos"] << 10, r["dim"], r["width"], r["ids"], r["labels"], r["x"]) for r in placed.where(F.col("pos").between(start, start + at_once - 1)).collect()]
        if n <= at_once:
            held = [a._replace(first=i << 10) for i, a in enumerate(held)]
        sent = spark.sparkContext.broadcast(held)
        found = _positives(candidates, sent, positives).toArrow()  # `positives` rows for each anchor at most
        anchor, place, score, vec_id = (found[c].to_numpy() for c in ("anchor", "place", "score", "vec_id"))
        of_block = {}
        for a in held:
            best = Best(len(a.ids), positives)
            mine = (anchor >> 10) == (a.first >> 10)
            at = (anchor[mine] - a.first, place[mine] - 1)
            best.scores[at], best.ids[at] = score[mine], vec_id[mine]
            of_block[a.first] = (best.scores, best.ids)
        parts.append(staged(_negatives(candidates, sent, spark.sparkContext.broadcast(of_block), negatives, low, high), "negatives"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
