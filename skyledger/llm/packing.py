"""Best-fit packing of token ids into sequences of several permitted lengths.

Texts are encoded (`bpe`; words by the tokenizers library, each once while it is kept), an end id is put after each, and documents longer than the longest sequence are cut, between tokens, into whole
sequences and a rest. Pieces are dealt by hash into groups of a bounded number of tokens; a group is packed by itself: longest piece
first, each into the open bin that it fills best. Where none has room, a bin is opened at the size that costs least for the pieces still to come; at the end
every bin is made as small as its contents allow.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.bpe import CACHED_WORDS, LibraryBpe, coder_for
from skyledger.llm.shared import dealt_out, let_go, map_batches, small_batches, staged
from skyledger.operators.order import with_position_in

#: Fixed value: the byte vocabulary's <|endoftext|>.
END_ID = 50256
#: Permitted lengths in tokens. A group has so many tokens and pieces on average.
SIZES = (512, 1024, 2048, 4096)
GROUP_TOKENS, GROUP_PIECES = 4_000_000, 20_000
#: Kinds of repeated pieces up to this number (8 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_REPEATED = 1_000_000


def opened_size(length: int, waiting: list[int], sizes: tuple[int, ...], overhead: int) -> int:
    """The bin to open for a piece: least waste per permitted size, if the longest waiting pieces that fit follow it.

    waiting: lengths still to be packed, ascending. overhead: what a bin costs besides its room.
    """
    if length == 0:  # the longest piece comes first, so nothing of any length waits
        return min(sizes)
    best, best_cost = sizes[-1], None
    for size in sizes:
        if size < length:
            continue
        room, filled, at = size - length, length, len(waiting)
        while room > 0:
            at = bisect_left(waiting, room + 1, 0, at) - 1
            if at < 0:
                break
            room -= waiting[at]
            filled += waiting[at]
        cost = (size + overhead) / filled
        if best_cost is None or cost < best_cost - 1e-12:
            best, best_cost = size, cost
    return best


def packed(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, place in the bin and bin size of every piece; pieces of no length lie in the first bin that comes."""
    order = np.argsort(-lengths, kind="stable")
    ascending = np.sort(lengths).tolist()
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    filled: list[int] = []
    sizes = tuple(sorted(sizes))
    for i in order.tolist():
        n = int(lengths[i])
        ascending.pop()
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            number, free = len(filled), opened_size(n, ascending, sizes, overhead)
            filled.append(0)
        bins[i], places[i] = number, filled[number]
        filled[number] += n
        insort(room, (free - n, number))
    smallest = np.array([next(s for s in sizes if s >= f) for f in filled] or [sizes[0]])
    return bins, places, smallest[bins] if len(lengths) else np.zeros(0, np.int64)


def id_kind(spec: str, end_id: int | None) -> str:
    """The numbers that hold a vocabulary file's ids: 16 bits where they suffice, else 32."""
    config = json.loads(spec)
    top = max([*config["model"]["vocab"].values(), *(t["id"] for t in config["added_tokens"]), end_id or 0])
    return "<u2" if top < 1 << 16 else "<u4"


def token_pieces(docs: DataFrame, vocabulary: str, longest: int, end_id: int | None, keep_ids: bool = True, cached_words: int = CACHED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, text_key, piece, start, length, and ids or ids_crc32) of every document: its ids, and the end id, cut into runs of at most `longest`.

    ids are bytes of numbers of the kind that comes with the table; without them (keep_ids) only their crc32 as 32-bit numbers is there.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec, kind = docs.sparkSession.sparkContext.broadcast(text), id_kind(text, end_id)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    last, value = ("ids binary", pa.binary()) if keep_ids else ("ids_crc32 long", pa.int64())

    def rows(batch: pa.RecordBatch) -> dict:
        coder, out = coder_for(spec.value, cached_words, LibraryBpe), ([], [], [], [], [])
        for i, text in enumerate(batch.column(2)):
            ids = coder.encode(text.as_py() or "") + end
            for piece, at in enumerate(range(0, max(len(ids), 1), 4 * longest)):
                part = ids[at : at + 4 * longest]
                told = np.frombuffer(part, "<u4").astype(kind).tobytes() if keep_ids else zlib.crc32(part)
                for column, x in zip(out, (i, piece, at // 4, len(part) // 4, told), strict=True):
                    column.append(x)
        at = pa.array(out[0], pa.int64())
        return {
            "doc_id": batch.column(0).take(at), "text_key": batch.column(1).take(at), "piece": pa.array(out[1], pa.int32()), "start": pa.array(out[2], pa.int64()),
            "length": pa.array(out[3], pa.int64()), last.split()[0]: pa.array(out[4], value),
        }

    slim = dealt_out(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")))
    return map_batches(slim, rows, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_key long, piece int, start long, length long, {last}", keeps=True, at_once=1024), kind


def with_deal(pieces: DataFrame) -> DataFrame:
    """The pieces (staged) with a hash by which they are dealt. Pieces that are the same in all respects are numbered, so that they go to several groups and a
    second run, however the files are split, gives the same bins."""
    same = pieces.withColumn("same", F.xxhash64("doc_id", "text_key", "piece"))
    repeated = staged(same.groupBy("same").count().where("count > 1").select("same"), "pack-repeated")
    if repeated.isEmpty():
        return same.withColumn("deal", F.xxhash64("same", F.lit(0).cast("long"))).drop("same")
    sent = F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATED else repeated
    several = same.join(sent, "same", "left_semi").withColumn("row", F.monotonically_increasing_id())
    numbered = with_position_in(several, ["same"], ["row"], name="copy", size="copies").drop("row", "copies")
    once = same.join(sent, "same", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(numbered).withColumn("deal", F.xxhash64("same", "copy")).drop("same", "copy")


def as_lists(runs: pa.ChunkedArray, kind: str) -> pa.ChunkedArray:
    """Lists of numbers from byte strings that hold them. All of a chunk are turned at once: a group holds millions."""
    lists, size = [], np.dtype(kind).itemsize
    for chunk in runs.cast(pa.binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], "<i4")[chunk.offset :][: len(chunk) + 1]
        first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
        numbers = np.frombuffer(chunk.buffers()[2], kind, (last - first) // size, first).astype("<i4") if last > first else np.zeros(0, "<i4")
        lists.append(pa.ListArray.from_arrays(pa.array((ends - first) // size, pa.int32()), pa.array(numbers)))
    return pa.chunked_array(lists, pa.list_(pa.int32()))


def pack(
    docs: DataFrame, vocabulary: str, sizes: tuple[int, ...] = SIZES, end_id: int | None = END_ID, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES,
    keep_ids: bool = True, cached_words: int = CACHED_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, text_key, piece, start, length, bin_id, bin_start, bin_size, and ids (keep_ids) or ids_crc32.

    A piece is tokens start to start + length of the document (its end id included); the pieces of a document are numbered from 0 and cover it. It
    lies in its bin from bin_start on. Null and empty texts are their end id alone, without an end id one piece without length. Whole texts
    are encoded, however long. Repeated rows are packed each; pieces of equal length go by a hash. A second run gives the same bins. Ids may be null. An
    empty table gives no rows. Columns of the table besides id and text do not matter. A worker keeps the ids of `cached_words` words at most (some 250 bytes each).
    """
    pieces, width = token_pieces(docs, vocabulary, max(sizes), end_id, keep_ids, cached_words, id_col, text_col)
    with small_batches(docs.sparkSession):
        pieces = staged(pieces, "pack-pieces")
    tokens, n = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(tokens or 0) // group_tokens), -(-n // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        let_go()  # the coder is not needed any more
        lengths = group["length"].to_numpy()
        order = np.lexsort((group["deal"].to_numpy(), -lengths))
        number, place, size = (np.zeros(len(order), np.int64) for _ in range(3))
        number[order], place[order], size[order] = packed(lengths[order], sizes)
        number += group["of"][0].as_py() << 40
        placed = {"bin_id": pa.array(number), "bin_start": pa.array(place), "bin_size": pa.array(size)}
        told = {"ids": as_lists(group["ids"], width)} if keep_ids else {"ids_crc32": group["ids_crc32"]}
        return pa.table({c: group[c] for c in ("doc_id", "text_key", "piece", "start", "length")} | placed | told)

    dealt = with_deal(pieces).withColumn("of", F.pmod("deal", F.lit(groups)))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    last = "ids array<int>" if keep_ids else "ids_crc32 long"
    return dealt.groupBy("of").applyInArrow(run, f"doc_id {kind}, text_key long, piece int, start long, length long, bin_id long, bin_start long, bin_size long, {last}")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: bin_id, bin_size, n (tokens), ids. pieces: rows of `pack` with ids; a bin has at most max(sizes) tokens."""
    own = F.sort_array(F.collect_list(F.struct("bin_start", "length", "ids")))
    whole = pieces.groupBy("bin_id").agg(F.first("bin_size").alias("bin_size"), F.sum("length").alias("n"), own.alias("own"))
    return whole.select("bin_id", "bin_size", "n", F.flatten(F.transform("own", lambda p: p["ids"])).alias("ids"))
