"""Hard negatives and importance resampling against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import negatives, resampling

#: Columns of the operators' own, which a table may have too.
CLASH = "anchor int, anchor_id int, block int, pos int, x int, score int, rank int, range int, at int, down int, first int, n int, dim int, place int, h string, weight int, run int, ids string"


def with_clashes(rows):
    return rows.selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in (c.split() for c in CLASH.split(", "))))


def slow_negatives(rows, every, k, scale):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of plain tuples (vec_id, vector, label)."""
    good = [(i, l, tuple(math.floor(float(c) * scale) for c in v)) for i, v, l in rows if None not in (i, v, l) and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, x in sorted({g for g in good if g[0] % every == 0}):
        score = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, m) for i, m, y in good if len(y) == len(x)]
        for s, p, _ in sorted(c for c in score if c[2] == label and c[1] != a)[:k]:
            near = sorted(c for c in score if c[2] != label and 80 * -s <= 100 * -c[0] <= 100 * -s)[:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(near, 1)]
    return Counter(out)


@pytest.mark.parametrize("anchor_bytes", [1, 1 << 20])
def test_hard_negatives(spark, anchor_bytes):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4 if i % 9 else 3)], draw.randrange(3)) for i in range(400)]
    rows += rows[:40] + [(1000 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(300)]  # repeated rows, and many equal vectors
    rows += [(None, [1.0] * 4, 1), (20, None, 1), (40, [1.0] * 4, None), (60, [float("nan")] * 4, 1), (80, [float("inf"), 1.0, 1.0, 1.0], 1), (100, [1.0, None, 1.0, 1.0], 1), (120, [], 1)]
    rows += [(7000 + 20 * i, [1e17 * (i + 1), -1e17, 3.0], i % 2) for i in range(4)] + [(20, [0.5] * 4, 2), (20, [0.5] * 4, 0)]  # large numbers; an anchor's id thrice
    table = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    small = [r for r in rows if (r[0] or 0) < 7000]
    got = negatives.hard_negatives(table.where("vec_id < 7000 OR vec_id IS NULL"), F.col("vec_id") % 20 == 0, anchor_bytes=anchor_bytes)
    found = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    # equal anchors of one id with other labels are anchors of their own, each row once
    assert found == slow_negatives(small, 20, 5, 256)
    assert negatives.hard_negatives(table, F.col("vec_id") % 20 == 0, anchor_bytes=anchor_bytes).count() >= len(found)
    for none in (table.limit(0), table.where("vec_id % 20 > 0")):
        assert negatives.hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0


def test_large_products_are_exact():
    draw = np.random.default_rng(1)
    x = draw.integers(-(1 << 40), 1 << 40, (6, 5))
    block = negatives._block(0, 5, 8, np.arange(6).tobytes(), np.zeros(6, np.int64).tobytes(), x.tobytes())
    got = negatives.products(block, block)
    want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x] for p in x]
    assert all(int(got[i, j]) == max(min(want[i][j], (1 << 63) - 1), -(1 << 63) + 2) for i in range(6) for j in range(6))
    best = negatives.Best(6, 2)
    best.offer(np.arange(6), got, np.ones((6, 6), bool), np.arange(6))
    assert [int(i) for i in best.ids[:, 0]] == [max(range(6), key=lambda j: (int(got[i, j]), -j)) for i in range(6)]


def test_best_scores_merge():
    """The best of any split of the columns, merged, are those of all columns."""
    draw = np.random.default_rng(2)
    scores, ids = draw.integers(0, 4, (7, 60)).astype(float), np.sort(draw.permutation(1000)[:60])
    whole = negatives.Best(7, 5)
    whole.offer(np.arange(7), scores, scores < 3, ids)
    halves = [negatives.Best(7, 5) for _ in range(2)]
    for half, part in zip(halves, (slice(0, 20), slice(20, 60)), strict=True):
        for at in range(part.start, part.stop, 10):
            cut = slice(at, at + 10)
            half.offer(np.arange(7), scores[:, cut], scores[:, cut] < 3, ids[cut])
    halves[0].merge(np.arange(7), halves[1].scores, halves[1].ids)
    assert (halves[0].scores == whole.scores).all() and (halves[0].ids == whole.ids).all()
    want = [sorted((-s, i) for s, i in zip(row, ids, strict=True) if s < 3)[:5] for row in scores]
    assert [[(-s, i) for s, i in zip(a, b, strict=True)] for a, b in zip(whole.scores.tolist(), whole.ids.tolist(), strict=True)] == [[(s, int(i)) for s, i in w] for w in want]


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [" ".join(p) for p in zip(words, words[1:], strict=False)], len(words)


def slow_resampling(docs, target, percent, least, seed):
    counts = [Counter(), Counter()]
    for side, texts in enumerate(([t for _, t in docs], target)):
        for text in texts:
            counts[side].update(zlib.crc32(f.encode()) % 10_000 for f in slow_features(text)[0])
    s, t = (sum(c.values()) + 10_000 for c in counts)
    gain = {b: math.floor(1000 * math.log((counts[1][b] + 1) * s / ((counts[0][b] + 1) * t))) for b in counts[0]}
    rows = []
    for doc_id, text in docs:
        found, words = slow_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    out = Counter((*r[:4], place) for place, r in enumerate(drawn, 1))
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return out + Counter({(*r, None): n for r, n in rest.items()})


@pytest.mark.parametrize(("percent", "range_rows"), [(25, 8192), (25, 3), (60, 1), (0, 3), (100, 10)])
def test_resampling(spark, percent, range_rows):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["Sun", "moon", "é", "漢字", "a1", "x-y", "ÀB", "z_z"]) for _ in range(draw.randrange(1, 60))) for _ in range(160)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 70 + [(500, None), (501, ""), (502, " .,;\n"), (None, texts[5]), (None, texts[5]), (-7, texts[9]), (503, "Long words " * 400_000)]
    target = ["sun moon a1", None, "", "漢字 é unseen words"]
    table = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table, goal, percent=percent, least_words=20, seed=7, range_rows=range_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == slow_resampling(docs, target, percent, 20, 7)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs, least_words=1).count() == 0
    rows = {r.doc_id: r for r in resampling.resample(docs, docs.limit(0), percent=100, least_words=1).collect()}
    assert rows[1]["rank"] == 1 and rows[1].n_features == 5 and rows[2]["rank"] is None and rows[2].weight == 0


def test_feature_runs_cross_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 3)
    text = "Aa bb-Cc  dd ee é9 " * 5
    for longest in (1, 2, 3):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        want = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        got, n = resampling.feature_buckets(text, longest)
        assert n == len(words) and Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in want)


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 8])
def test_tournament_merges_runs(runs):
    draw = random.Random(runs)
    lists = [sorted((draw.randrange(20), i, k) for k in range(draw.randrange(0, 30))) for i in range(runs)]
    assert list(resampling.Tournament(lists)) == list(heapq.merge(*lists))


def test_rows_fall_into_ranges():
    draw = np.random.default_rng(4)
    cuts = np.array(sorted(map(tuple, draw.integers(0, 3, (9, 4)).tolist())))
    rows = draw.integers(0, 3, (200, 4))
    got = resampling.ranges_of(list(rows.T), list(cuts.T))
    assert got.tolist() == [sum(tuple(c) <= tuple(r) for c in cuts.tolist()) for r in rows.tolist()]
    assert resampling.ranges_of(list(rows.T), [np.zeros(0, np.int64)] * 4).tolist() == [0] * 200


def test_toxicity_score_is_that_of_plain_loops():
    """The score of a text from the vectors themselves, word by word and passage by passage."""
    from skyledger.llm import toxicity

    draw = np.random.default_rng(9)
    model = toxicity.Model(draw.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), draw.normal(0, 1, (2, toxicity.DIM)), -0.7)
    judge = toxicity.Judge(model.scale(), model.bias)
    rng = random.Random(9)
    for n in (0, 1, 5, 6, 7, 40):
        text = " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(n))
        words = re.findall(r"[^\W\d_]+", text.lower())
        odds = []
        for at in range(max(1, len(words) - toxicity.PASSAGE + 1)):
            passage = words[at : at + toxicity.PASSAGE]
            total = np.zeros(toxicity.DIM)
            for word in passage:
                marked = f"<{word}>"
                grams = [marked[i : i + k] for k in range(3, 6) for i in range(len(marked) - k + 1)] + [marked]
                total += np.mean([model.vectors[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams], 0)
            mean = total / max(1, len(passage))
            odds.append(float(model.weights[1] @ mean - model.weights[0] @ mean + model.bias))
        weight = [math.exp(toxicity.POOL * o) for o in odds]
        log_odds = sum(w * o for w, o in zip(weight, odds, strict=True)) / sum(weight)
        assert judge.score(text) == pytest.approx(1 / (1 + math.exp(-log_odds)), abs=1e-9)


def test_sorted_runs_merge():
    """Merging two runs gives what a memtable of both gives; ranges cut runs in their order."""
    from skyledger.llm import exact_dedup

    draw = np.random.default_rng(10)
    for keep in ("min", "max"):
        for sizes in ((0, 5), (5, 0), (40, 60), (300, 7)):
            parts = []
            for n in sizes:
                digests = np.array([bytes([int(x)]) + b"\0a" for x in draw.integers(0, 120, n)], "S3")
                parts.append(exact_dedup.memtable(digests, draw.integers(0, 50, n), draw.random(n) < 0.8, draw.integers(1, 4, n), keep))
            got = exact_dedup.merged_runs(*parts, keep)
            want = exact_dedup.memtable(*(np.concatenate(c) for c in zip(*parts, strict=True)), keep)
            for g, w, there in zip(got, want, (None, want[2], None, None), strict=True):
                assert (g == w).all() if there is None else (g[there] == w[there]).all()
            at = exact_dedup.ranges_of(want[0], 7)
            assert (np.diff(at) >= 0).all() and (not len(at) or 0 <= at.min() <= at.max() < 7)


def slow_edit(old, stats, order, shards):
    """The next map {unit: shard} in plain loops. old: {unit: shard}; stats: {unit: bytes}; order: {unit: its hash}. A unit is (vslot, text_key, part)."""
    fair = sum(stats.values()) / shards
    now, loads, filled, over = {}, [0] * shards, Counter(), []
    was = {u: old.get(u, old.get((u[0], 0, -1))) for u in stats}
    for u in sorted(stats, key=lambda u: (order[u], u)):
        filled[was[u]] += stats[u]
        if was[u] is not None and was[u] < shards and filled[was[u]] <= fair:
            now[u] = was[u]
            loads[was[u]] += stats[u]
        else:
            over.append(u)
    for u in sorted(over, key=lambda u: (-stats[u], u)):
        now[u] = loads.index(min(loads))
        loads[now[u]] += stats[u]
    return now | {u: s for u, s in old.items() if u[1:] == (0, -1) and u not in stats and s < shards}


@pytest.mark.parametrize(("before", "after"), [(8, 8), (8, 9), (8, 5)])
def test_edited_maps_are_those_of_plain_loops(spark, before, after):
    """Maps of documents with large groups, edited twice; and every row's place follows from map and unit alone."""
    from skyledger.llm import sharding

    rng = random.Random(11)
    rows = [(i, "word " * rng.randrange(0, 40)) for i in range(300)] + [(400 + i, "a large group " * 9) for i in range(60)] + [(500 + i, "larger " * 60) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    unit = lambda r: (r.vslot, r.text_key, r.part)
    now = sharding.first_map(spark, before, 64)
    for shards in (before, after):
        slots = sharding.slot_rows(docs, 64)
        stats = sharding.unit_stats(sharding.in_units(slots, sharding.large_groups(slots, shards, 64)))
        held = stats.withColumn("h", F.xxhash64(*sharding.UNIT)).collect()
        old = {unit(r): r.shard for r in now.collect()}
        want = slow_edit(old, {unit(r): r.bytes for r in held}, {unit(r): r.h for r in held}, shards)
        now = sharding.edited_map(now, stats, shards)
        assert {unit(r): r.shard for r in now.collect()} == want and now.count() == len(want)
        assert len(want) > 64 and set(want.values()) <= set(range(shards))


def test_few_cached_words_change_nothing():
    from skyledger.llm import bpe
    from skyledger.llm.vocabularies import vocabulary

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    few, many = bpe.ByteBpe(spec, 4), bpe.ByteBpe(spec)
    rng = random.Random(12)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcé 1", k=rng.randrange(1, 6))) for _ in range(40))
        assert few.encode(text) == many.encode(text)
        assert len(few.words) + len(few.words.before) <= 4


def test_few_cells_change_nothing():
    """The automaton's table holds no more cells than it may, and gives the same ids."""
    from skyledger.llm import bpe
    from skyledger.llm.vocabularies import vocabulary

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    few, many = bpe.ByteBpe(spec, 20), bpe.ByteBpe(spec)
    rng = random.Random(13)
    for _ in range(300):
        word = "".join(rng.choices("abcdeé 1", k=rng.randrange(1, 12)))
        assert few.encode(word) == many.encode(word)
        assert len(few.automaton.table) <= 20
    assert len(many.automaton.table) > 20


def test_packing_encodes_as_the_automaton_does():
    """Words that the library is asked for have the automaton's ids, each asked for once while it is kept; no automaton is built for packing."""
    from skyledger.llm import bpe
    from skyledger.llm.vocabularies import vocabulary

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    ours, theirs = bpe.ByteBpe(spec), bpe.coder_for(spec, 1000, bpe.LibraryBpe)
    asked, plain = [], theirs.word_ids
    theirs.word_ids = lambda word: asked.append(word) or plain(word)
    rng = random.Random(14)
    texts = ["", " ", "a<|endoftext|>b<|endoftext|>", "日本語 テキスト１２", "\ud800 z", "\U0001f600\U0010ffff\u0378x", "it's  l'été ½²", "\x00\x1c\x1f\t\r\n \n x"]
    texts += [" ".join("".join(rng.choices("abcdeé 1ß日.", k=rng.randrange(1, 14))) for _ in range(20)) for _ in range(100)]
    for text in texts:
        assert theirs.encode(text) == ours.encode(text)
    assert not hasattr(theirs, "automaton")
    theirs.encode("onceonly")
    before = len(asked)
    theirs.encode("onceonly")
    assert len(asked) == before


def test_packing_takes_few_bytes_at_once(spark, monkeypatch):
    """Texts go to the workers in batches of bounded bytes, and the session's own bound holds again afterwards."""
    import pyarrow as pa

    from skyledger.llm import packing, shared

    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(i, "x" * 10_000) for i in range(400)], "doc_id long, text string").coalesce(1)
    before, bound = spark.conf.get(name), 200_000
    monkeypatch.setattr(shared, "SMALL_BATCH", bound)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches), "n long")
    with packing.small_batches(spark):
        assert max(r.n for r in sizes.collect()) < 2 * bound
    assert spark.conf.get(name) == before and max(r.n for r in sizes.collect()) > 10 * bound


def test_ids_of_a_group_as_lists():
    import pyarrow as pa

    from skyledger.llm.packing import as_lists

    for kind in ("<u2", "<u4"):
        want = [[1, 2, 65_535], [], [7], [50_256] * 5]
        told = pa.array([np.array(x, kind).tobytes() for x in want])
        assert as_lists(pa.chunked_array([told, told.slice(1, 2), told.slice(4)]), kind).to_pylist() == want + want[1:3]
    assert as_lists(pa.chunked_array([], pa.binary()), "<u2").to_pylist() == []
