"""Exact Jaccard joins of shingle sets: prefixes propose pairs, vertical fragments of the sets decide about them.

All shingles have one order, rare ones first (by how many sampled documents have them, then by hash). Of a set's n shingles the first
n - ceil(bound * n) + 1 are its keys; two sets at the bound share a key, the first shingle that both have. Where that one stands, how many shingles
the sets have, and the parities of their shingles bound what they can share. The sample decides the cost, not the result.

* Equal sets are one class, told by a digest of 128 bits; only one of each goes on.
* Keys that occur once, nearly all of them, never move: hashes of four bytes a key are exchanged first, and those met again fill a bitmap of bounded
  size, which every key must pass. What passes in vain costs work, never a link.
* A key is not turned into all its pairs. First its members are compared with its smallest; verified links make components. Then only members outside
  the key's largest component meet the key's other members, chunk by chunk. A pair within one component needs no further look, nor one that has met before:
  a member knows its last few keys, and a pair that shares one of them was looked at there.
* A pair is decided by vertical partitioning: the order is cut into fragments, every set into the segments that fall into them. A pair's segments of
  one fragment meet by themselves, their partial overlap is counted there, and the counts are summed per pair. So no row holds a whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.components import components
from skyledger.llm.shared import dealt_out, hot_keys, let_go, map_batches, salted_join, small_batches, staged
from skyledger.llm.simhash import fingerprint, shingle_hashes

#: One in so many documents is read for the order of shingles; so many frequent ones at most (12 bytes each) are put last.
SAMPLED, FREQUENT = 16, 100_000
#: Columns of a text's parities (64 bits each).
ODD = [f"s{i}" for i in range(8)]
#: Fragments of the order's rare shingles (a power of two); the frequent ones are one more.
FRAGMENTS = 8
#: Tables of classes up to this number (some 20 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Sets that are to be compared, up to this number (some 100 bytes each) broadcast to the readers of texts.
BROADCAST_WANTED = 100_000
#: Whole texts whose shingles a worker holds at once.
TEXTS_AT_ONCE = 256
#: Members of a key that a row meets in one task, and keys before this one that a row knows.
CHUNK, KNOWN = 256, 4
#: Bits of the bitmap of keys met again, at most (16 MB), keys of a bucket that look for those on average, and keys that a task gathers before it sends them.
AGAIN_BITS, BUCKET_KEYS, GATHERED = 27, 1 << 20, 1 << 20


def parities(hashes: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers: bit i tells whether an odd number of the distinct hashes leaves i; two sets differ in at least as many members as bits."""
    counts = np.bincount((hashes & np.uint64(64 * len(ODD) - 1)).astype(np.int64), minlength=64 * len(ODD))
    return np.packbits(counts & 1 == 1).view(np.int64)


def digest_of(distinct: np.ndarray) -> bytes:
    """128 bits of a set of hashes (ascending)."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (ascending) that most sampled documents have, and how many have them. docs: (id, text)."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [np.unique(shingle_hashes(t.as_py() or "", words)) for t in batch.column(0)]
        return {"key": pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())}

    sampled = map_batches(docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text"), rows, "key long", at_once=TEXTS_AT_ONCE)
    with small_batches(docs.sparkSession):
        counts = staged(sampled.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"), "near-frequent")
    least, total = 1 << 62, 0
    for n, keys in sorted(((r["n"], r["keys"]) for r in counts.groupBy("n").agg(F.count("*").alias("keys")).collect()), reverse=True):
        total += keys
        if total > FREQUENT:
            break
        least = n
    found = counts.where(F.col("n") >= least).toArrow()
    keys, often = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int32)
    order = np.argsort(keys)
    return keys[order], often[order]


def _where_frequent(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return at, frequent[at] == hashes


def prefix(hashes: np.ndarray, percent: int, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes (ascending): those first in the order, one of which any set that is similar enough has too."""
    if len(frequent):
        at, known = _where_frequent(hashes, frequent)
        hashes = hashes[np.argsort(np.where(known, often[at], 0), kind="stable")]
    return hashes[: len(hashes) - -(-percent * len(hashes) // 100) + 1]


def segments(hashes: np.ndarray, frequent: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(fragment, hashes) of a set (ascending) for the fragments that it has shingles in: runs of the order, which is by hash among the rare ones."""
    known = _where_frequent(hashes, frequent)[1] if len(frequent) else np.zeros(len(hashes), bool)
    rare = hashes[~known]
    cuts = np.searchsorted(rare, np.arange(FRAGMENTS + 1, dtype=np.float64) * (2.0**64 / FRAGMENTS)) if len(rare) else np.zeros(FRAGMENTS + 1, np.int64)
    cuts[-1] = len(rare)
    parts = [(i, rare[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))] + [(FRAGMENTS, hashes[known])]
    return [(i, part) for i, part in parts if len(part)]


def sketches(docs: DataFrame, words: int, percent: int, order, blank: bool = False) -> DataFrame:
    """(row, id, n, fp, digest, s0 to s7, keys) of every document (id, text): a number of its own, its distinct shingles' number, SimHash
    fingerprint, digest, parities and keys in their order (8 bytes each). Texts without words have no keys; with `blank` one that only they have."""

    def rows(batch: pa.RecordBatch) -> dict:
        n, fp, digest, odd, keys = [], [], [], [], []
        for text in batch.column(1):
            hashes = shingle_hashes(text.as_py() or "", words)
            distinct = np.unique(hashes)
            n.append(len(distinct))
            fp.append(fingerprint(hashes))
            digest.append(digest_of(distinct))
            odd.append(parities(distinct))
            keys.append(prefix(distinct, percent, *order.value).tobytes() if len(distinct) else bytes(8) * blank)
        sides = np.array(odd, np.int64).reshape(-1, len(ODD))
        out = {"id": batch.column(0), "n": pa.array(n, pa.int32()), "fp": pa.array(fp, pa.int64()), "digest": pa.array(digest, pa.binary())}
        return out | {c: pa.array(sides[:, i]) for i, c in enumerate(ODD)} | {"keys": pa.array(keys, pa.binary())}

    kind = docs.schema["id"].dataType.simpleString()
    made = map_batches(dealt_out(docs.select("id", "text")), rows, f"id {kind}, n int, fp long, digest binary, {', '.join(f'{c} long' for c in ODD)}, keys binary", at_once=4 * TEXTS_AT_ONCE)
    return made.withColumn("row", F.monotonically_increasing_id())


def _met_again(sets: DataFrame, total: int) -> np.ndarray:
    """A bitmap over the top bits of the keys of all sets (column keys), set for every key that two sets have and some others. total: number of keys."""
    split = min(20, max(6, (total // BUCKET_KEYS).bit_length()))
    bits = min(AGAIN_BITS, max(split + 3, (16 * total).bit_length()))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()

        def told(held: list[bytes]) -> pa.RecordBatch:
            keys = np.sort(np.frombuffer(b"".join(held), np.uint64))
            bucket = keys >> np.uint64(64 - split)
            starts = np.nonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))[0]
            rest = ((keys << np.uint64(split)) >> np.uint64(32)).astype(np.uint32)
            parts = [rest[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(rest)], strict=True)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts].astype(np.int64)), "rest": pa.array(parts, pa.binary())})

        held, size = [], 0
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                held.append(keys)
                size += len(keys) // 8
                if size >= GATHERED:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    def twice(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        found, n = np.unique(np.frombuffer(b"".join(table["rest"].to_pylist()), np.uint32), return_counts=True)
        flags = np.zeros(1 << (bits - split), np.uint8)
        flags[found[n > 1] >> np.uint32(32 - (bits - split))] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "slice": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    found = sets.select("keys").mapInArrow(sent, "bucket long, rest binary").groupBy("bucket").applyInArrow(twice, "bucket long, slice binary").toArrow()
    size = 1 << (bits - split - 3)
    for bucket, part in zip(found["bucket"].to_pylist(), found["slice"].to_pylist(), strict=True):
        out[bucket * size : (bucket + 1) * size] = np.frombuffer(part, np.uint8)
    return out


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, node, n, at) of the keys that pass the bitmap of those met again; `at` is the key's place in the set. sets: (node, n, keys)."""
    total = sets.agg(F.sum(F.length("keys") / 8).cast("long")).first()[0] or 0
    again = sets.sparkSession.sparkContext.broadcast(_met_again(sets, total))

    def rows(batch: pa.RecordBatch) -> dict:
        bitmap = again.value
        raw = batch.column(2).to_pylist()
        sizes = np.array([len(k) // 8 for k in raw], np.int64)
        keys = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = keys >> np.uint64(64 - (len(bitmap).bit_length() + 2))
        good = np.nonzero(bitmap[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)[0]
        which = pa.array(owner[good])
        return {"key": pa.array(keys[good].view(np.int64)), "node": batch.column(0).take(which), "n": batch.column(1).take(which), "at": pa.array(place[good].astype(np.int32))}

    return map_batches(sets.select("node", "n", "keys"), rows, "key long, node long, n int, at int", at_once=4 * TEXTS_AT_ONCE)


def _shared_least(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of n and m share at least if they are similar enough."""
    return F.ceil((n + m) * (percent / (100 + percent)) - 1e-9)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _possible(left: str, right: str, percent: int) -> Column:
    """Whether the similarity can be reached if this key is the first shingle that both sets have."""
    n, at, m, bt = (F.col(side + c) for side in (left, right) for c in ("n", "at"))
    return _sizes_fit(n, m, percent) & (F.least(n - at, m - bt) >= _shared_least(n, m, percent))


def _over(percent: int) -> Column:
    """By how many bits the parities differ more than those of similar sets can; 0 or less is possible."""
    n, m = F.col("a_n"), F.col("b_n")
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ODD), F.lit(0))
    return apart - (n + m - 2 * _shared_least(n, m, percent))


def with_both(edges: DataFrame, of_node: DataFrame, columns: list[str]) -> DataFrame:
    """The edges (a, b; staged) with the columns of both nodes, those of a as a_..., of b as b_...; a node of many edges is spread."""
    hot = [hot_keys(edges, side) for side in ("a", "b")]
    for side, other, many in (("a", "b", hot[0]), ("b", "a", hot[1])):
        named = of_node.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        edges = salted_join(edges, named, side, other, many)
    return edges


class Join:
    """The sets of documents (id, text) that are to be joined: sketched, with their classes; finds the links at `percent` or more."""

    def __init__(self, docs: DataFrame, words: int, percent: int, blank: bool = False):
        self.docs, self.words, self.percent, self.blank = docs, words, percent, blank
        self.order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
        with small_batches(docs.sparkSession):
            self.rows = staged(sketches(docs, words, percent, self.order, blank), "near-sketches")
        some = self.rows if blank else self.rows.where("n > 0")
        # a class's node is the number of one of its rows; `least` is its smallest id
        self.classes = staged(some.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least")), "near-classes")
        node = self.classes.select(F.col("node").alias("row"))
        self.sets = self.rows.join(F.broadcast(node) if self.classes.count() <= BROADCAST_NODES else node, "row").withColumnRenamed("row", "node")
        self.light = staged(self.sets.select("node", "n", "fp", "id", "digest", *ODD), "near-light")

    def told(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sizes and parities allow the similarity, each once, with both ids, digests and sizes; staged."""
        both = with_both(staged(pairs.distinct(), f"{name}-all"), self.light, ["n", "id", "digest", *ODD])
        fits = both.where(_sizes_fit(F.col("a_n"), F.col("b_n"), self.percent)).withColumn("score", _over(self.percent)).where("score <= 0")
        return staged(fits.select("a", "b", *(f"{s}_{c}" for s in "ab" for c in ("n", "id", "digest"))), name)

    def segments(self, edges: DataFrame) -> DataFrame:
        """Segments of the sets of edges (as `told` gives them), each where it is compared: (piece, b, part), a piece being the digest of the edge's first
        set and a fragment's number. b is the edge's second set, whose part it is; null where it is the first set's own."""
        first = edges.groupBy("a").agg(F.any_value("a_id").alias("_id"), F.any_value("a_digest").alias("_digest"))
        second = edges.groupBy("b").agg(F.any_value("b_id").alias("_id"), F.any_value("b_digest").alias("_digest"), F.collect_list("a_digest").alias("_to"))  # as many as it has keys at most
        wanted = first.select("_id", "_digest", F.lit(None).cast("long").alias("_b"), F.array("_digest").alias("_to")).unionByName(second.select("_id", "_digest", F.col("b").alias("_b"), "_to"))
        wanted = staged(wanted, "near-wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WANTED else wanted
        ids = F.broadcast(wanted.select("_id").distinct()) if wanted.count() <= BROADCAST_WANTED else wanted.select("_id").distinct()
        docs = self.docs.select("id", "text")
        near = docs.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        if not near.groupBy("id").count().where("count > 1").isEmpty():
            docs = near.dropDuplicates(["id", "text"])  # a row and its copies have their segments once
        order, words = self.order, self.words

        def rows(batch: pa.RecordBatch) -> dict:
            pieces, owners, parts = [], [], []
            for text, want, b, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                distinct = np.unique(shingle_hashes(text.as_py() or "", words))
                if digest_of(distinct) != want.as_py():
                    continue  # another text of the same id
                owner, places = b.as_py(), to.as_py()
                for i, part in segments(distinct, order.value[0]):
                    for digest in places:
                        pieces.append(digest + bytes([i]))
                        owners.append(owner)
                        parts.append(part.tobytes())
            return {"piece": pa.array(pieces, pa.binary()), "b": pa.array(owners, pa.int64()), "part": pa.array(parts, pa.binary())}

        joined = docs.join(wanted, F.col("id").eqNullSafe(F.col("_id"))).select("text", "_digest", "_b", "_to")
        return map_batches(dealt_out(joined), rows, "piece binary, b long, part binary", at_once=TEXTS_AT_ONCE)

    def verified(self, edges: DataFrame) -> DataFrame:
        """The edges (as `told` gives them) whose sets have the similarity: partial overlaps by fragment, summed per pair. (a, b), staged."""
        parts = self.segments(edges)
        with small_batches(edges.sparkSession):
            parts = staged(parts, "near-segments")
        own = parts.where("b IS NULL").select("piece", F.col("part").alias("own"))
        hot = hot_keys(parts.where("b IS NOT NULL"), "piece")
        met = salted_join(parts.where("b IS NOT NULL"), own, "piece", "b", hot)

        def overlaps(batch: pa.RecordBatch) -> dict:
            shared = [np.intersect1d(*(np.frombuffer(x.as_py(), np.uint64) for x in pair), assume_unique=True).size for pair in zip(batch.column(2), batch.column(3), strict=True)]
            return {"a_digest": pa.array([p.as_py()[:16] for p in batch.column(0)], pa.binary()), "b": batch.column(1), "shared": pa.array(shared, pa.int64())}

        partial = map_batches(met.select("piece", "b", "part", "own"), overlaps, "a_digest binary, b long, shared long", at_once=8 * TEXTS_AT_ONCE)
        sums = partial.groupBy("a_digest", "b").agg(F.sum("shared").alias("shared"))
        told = edges.select("a", "b", "a_n", "b_n", "a_digest").join(sums, ["a_digest", "b"])
        # both sets of a pair are empty only where blank texts are alike; they are one class then
        return staged(told.where((100 + self.percent) * F.col("shared") >= self.percent * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "near-edges")

    def components(self, proposed: DataFrame | None = None) -> DataFrame:
        """(node, root) of every class that is linked to another; root is the smallest node that links lead to. proposed: pairs (a, b) to try beside the keys'."""
        percent = self.percent
        shared = staged(shared_keys(self.sets), "near-shared")
        hubs = staged(shared.groupBy("key").agg(F.min(F.struct("node", "n", "at")).alias("hub"), F.count("*").alias("members")).where("members > 1"), "near-hubs")
        crowded = staged(hot_keys(hubs, "key", "members"), "near-crowded")
        hub = [F.col(f"hub.{c}").alias(f"h_{c}") for c in ("node", "n", "at")]
        met = salted_join(shared, hubs.select("key", *hub), "key", "node", crowded)
        spokes = met.where((F.col("node") != F.col("h_node")) & _possible("", "h_", percent)).select(F.col("h_node").alias("a"), F.col("node").alias("b"))
        tried = self.told(spokes if proposed is None else proposed.unionByName(spokes), "near-spokes")
        edges = self.verified(tried)

        found = staged(components(edges), "near-components")
        members = salted_join(shared, hubs.select("key"), "key", "node", crowded)
        placed = members.join(found, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))
        split = staged(placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("split")).where("split").drop("split"), "near-split")
        open_ = staged(salted_join(placed, split, "key", "node", crowded), "near-open")
        rest = staged(_apart_pairs(open_, self.light.select("node", *ODD), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "near-rest")
        # of a document's pairs with one component the likeliest goes first; it often saves the others
        first = staged(rest.groupBy("root", "b").agg(F.min_by("a", F.struct("score", "a")).alias("a")).select("a", "b"), "near-first")
        edges = edges.unionByName(self.verified(self.told(first, "near-first-told")))
        found = staged(components(edges), "near-components")
        roots = [found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")) for side in ("a", "b")]
        still = rest.select("a", "b").join(first, ["a", "b"], "left_anti").join(roots[0], "a", "left").join(roots[1], "b", "left")
        still = staged(still.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "near-still")
        if still.isEmpty():
            return found
        return staged(components(edges.unionByName(self.verified(self.told(still, "near-still-told")))), "near-components")


def _with_known(lists: DataFrame) -> DataFrame:
    """(key, at, known, node, n, root, parities) of each key of nodes (keys, ats: their keys in order, and places): `known` are up to KNOWN keys before it."""
    known = f"slice(keys, greatest(i - {KNOWN} + 1, 1), least(i, {KNOWN}))"
    return lists.select(F.expr(f"inline(transform(keys, (k, i) -> named_struct('key', k, 'at', ats[i], 'known', {known})))"), "node", "n", "root", *ODD)


def _apart_pairs(rows: DataFrame, odd: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (key, node, root, n, at) of one key, but of different roots, that can be similar enough; with their roots and score. odd: the nodes' parities.

    Rows outside the key's largest root meet all rows of the key, which are dealt into chunks of about CHUNK. Scores are lower for pairs more likely to
    be similar. A pair's first common key is the one by which it is judged; those that follow it closely in both sets do not make the pair again.
    """
    # a node has as many keys as its text's prefix at most
    lists = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "key"))).alias("own"))
    lists = lists.select("node", "n", "root", F.col("own.key").alias("keys"), F.col("own.at").alias("ats"))
    lists = staged(lists.join(odd, "node"), "near-lists")
    by_root = staged(rows.groupBy("key", "root").agg(F.count("*").alias("n_root")), "near-roots")
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("main"), F.ceil(F.sum("n_root") / CHUNK).cast("int").alias("chunks"), F.sum("n_root").alias("members"))
    main = staged(main, "near-main")
    marked = staged(salted_join(_with_known(lists), main.drop("members"), "key", "node", hot_keys(main.select("key", "members"), "key", "members")), "near-marked")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    there = marked.select("key", chunk.alias("chunk"), (F.col("root") == F.col("main")).alias("b_main"), *(F.col(c).alias(f"b_{c}") for c in ("node", "root", "n", "at", "known", *ODD)))
    here = marked.where("root <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("main", "chunks")
    here = here.select("key", "chunk", *(F.col(c).alias(f"a_{c}") for c in ("node", "root", "n", "at", "known", *ODD)))
    once = F.col("b_main") | (F.col("a_node") < F.col("b_node"))
    met = here.join(there, ["key", "chunk"]).where((F.col("a_root") != F.col("b_root")) & once & _sizes_fit(F.col("a_n"), F.col("b_n"), percent))
    scored = met.withColumn("score", _over(percent)).where((F.col("score") <= 0) & _possible("a_", "b_", percent) & ~F.arrays_overlap("a_known", "b_known"))
    a, b = (F.struct(F.col(f"{s}_node").alias("node"), F.col(f"{s}_root").alias("root"), F.col(f"{s}_n").alias("n")) for s in ("a", "b"))
    pairs = scored.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "score")
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("root"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), "score")
    each = with_both(staged(pairs.distinct(), "near-apart"), lists.select("node", "keys"), ["keys"])
    # sets of different roots meet at every key that both have, so these are all that their keys share; the rest of one of them is all that may come to it
    beyond = lambda n: F.ceil(n * percent / 100 - 1e-9) - 1
    reach = F.size(F.array_intersect("a_keys", "b_keys")) + F.greatest(beyond(F.col("n")), beyond(F.col("m")))
    return each.where(reach >= _shared_least(F.col("n"), F.col("m"), percent)).select("a", "b", "root", "score")
