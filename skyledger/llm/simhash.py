"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into radius + 3 blocks. Two fingerprints at most `radius` bits apart agree in all but `radius` blocks,
so they share one of the keys made of 3 blocks (radius 2: 10 keys of 38 bits). Equal keys are joined and the distance is
verified. Copies never meet: the join runs over distinct fingerprints.

Keys with many fingerprints would make all pairs, so they go another, exact way: a fingerprint of such a key is linked to the
smallest of those one bit from each of its own one-bit neighbours. Fingerprints two bits apart have such a neighbour in common, and any
two around one neighbour are at most two bits apart; a neighbour has 65 fingerprints at most. (For a radius over 2, neighbours
at half the radius serve in the same way, and the distance is verified.)
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.components import components
from skyledger.llm.shared import dealt_out, hot_keys, map_batches, salted_join, staged

BITS = 64
#: Keys with more distinct fingerprints than this go by neighbours instead of pairs.
PAIRED = 64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of lower-cased (A-Z) words, repeats included; fewer words: of all of them; none: empty."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), 42)], np.uint64)
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[start : start + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text; null and blank texts have fingerprint zero."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(shingle_hashes(t.as_py() or "", words)) for t in batch.column(1)]
        return {"doc_id": batch.column(0), "fp": pa.array(found, pa.int64())}

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(dealt_out(slim), rows, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks of `blocks` runs of bits, as equal as can be."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_keys(fp: Column, radius: int) -> Column:
    """The keys as an array of structs (which blocks, their bits)."""
    masks = block_masks(radius + 3)
    chosen = [sum(c) for c in combinations(masks, 3)]
    return F.array(*(F.struct(F.lit(k).alias("which"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(chosen)))


def links(distinct: DataFrame, radius: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that connect just what pairs within `radius` bits connect."""
    if radius not in (0, 1, 2):
        raise ValueError("radius is 0, 1 or 2")
    keyed = staged(distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key")), "fp-blocks")
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "fp-sizes")
    members = staged(salted_join(keyed, sizes, "key", "fp", hot_keys(sizes, "key", "n")), "fp-members")
    few = members.where(F.col("n") <= paired)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, "key").where((F.col("a") > F.col("b")) & close).select("a", "b")

    many = members.where(F.col("n") > paired).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BITS)))
    around = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    hubs = around.groupBy("centre").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    stars = hubs.select(F.explode("near").alias("a"), "b").where("a > b")
    if radius < 2:  # around one centre fingerprints are up to two bits apart
        stars = hubs.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b")).where((F.col("a") > F.col("b")) & close)
    return pairs.unionByName(stars.select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links lead to).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Whole texts are read, however long. Null ids are kept; they never are
    a component's id unless it has no other. Repeated rows are each returned. An empty table gives no rows. Other columns do not matter. Fingerprints that
    many texts have, and components of many fingerprints, are spread over tasks.
    """
    rows = staged(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fp-distinct")
    roots = components(links(distinct.select("fp"), radius, paired))
    in_component = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "fp-roots")
    smallest = staged(in_component.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "fp-smallest")
    by_fp = staged(salted_join(in_component.select("fp", "rows", "root"), smallest.drop("n"), "root", "fp", hot_keys(smallest, "root", "n")).drop("root"), "fp-components")
    # rows of one fingerprint are spread by their places, as ids may be repeated
    named = salted_join(rows.withColumn("_row", F.monotonically_increasing_id()), by_fp.drop("rows"), "fp", "_row", hot_keys(by_fp, "fp", "rows"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
