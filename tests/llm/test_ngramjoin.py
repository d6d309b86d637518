"""The n-gram join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from skyledger.llm import ngramjoin, setjoin, shared
from skyledger.llm.simhash import shingle_hashes

CLASH = "id int, row int, node int, n int, root int, key int, digest string, least int, component_id int, piece string, part string, a int, b int, fp int, s0 int"


def brute(rows, words, percent):
    """(doc_id, n_shingles, component_id) of plain rows (doc_id, text)."""
    sets = [set(shingle_hashes(t or "", words).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc_id) if x is not None), default=None)
    return Counter((doc_id, len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows))


def made_words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def families(rng):
    """Copies about the bound of 0.85, chains of them, a crowd, a passage that many share, repetitive texts, short ones."""
    for n in (4, 5, 9, 14, 21, 40, 90, 250):
        for _ in range(6):
            base, cut = made_words(rng, n), max(1, n * 3 // 20)
            changed = list(base)
            for at in rng.sample(range(n), max(1, n // 60)):
                changed[at] = made_words(rng, 1)[0]
            yield from (base, changed, base[:-cut], base[cut:], [*base[: n // 2], *made_words(rng, max(1, n // 8)), *base[n // 2 :]])
    chain = made_words(rng, 60)
    for _ in range(12):
        chain = [*chain[1:], *made_words(rng, 1)]
        yield list(chain)
    base = made_words(rng, 70)
    yield from ([*base[:k], *made_words(rng, 1), *base[k + 1 :]] for k in range(50))
    passage = made_words(rng, 55)
    yield from ([*made_words(rng, rng.randrange(5, 40)), *passage, *made_words(rng, 4)] for _ in range(40))
    few = made_words(rng, 6)
    yield from (rng.choices(few, k=60) for _ in range(20))


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_ngram_join_loses_no_link(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "HOT_ROWS", 16)
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    monkeypatch.setattr(setjoin, "BROADCAST_NODES", bound)
    monkeypatch.setattr(setjoin, "BROADCAST_WANTED", bound)
    rng = random.Random(4)
    rows = [(1000 - i if i % 7 else 5000 + i, " ".join(words)) for i, words in enumerate(families(rng))]
    copied = rows[3][1]
    rows += [(9000 + i, copied) for i in range(60)] + [(77, copied)] * 20  # a group of copies, and repeated rows
    rows += [(77, "another text with this id than those above"), (None, copied), (None, "no id at all"), (None, "No ID at all"), (1, None), (2, ""), (3, " \n\t"), (3, " "), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "é É ß 漢字"), (8, "É É ß 漢字")]
    rows += [(10, "long " * 40_000), (11, "long " * 39_000), (12, " ".join(map(str, range(50_000)))), (13, " ".join(map(str, range(3, 50_000))))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    table = table.selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in (c.split() for c in CLASH.split(", "))))
    got = ngramjoin.ngram_links(table)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 4, 85)
    assert ngramjoin.ngram_links(table.limit(0)).count() == 0


def test_sets_without_links(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (4, "f g h i j")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngramjoin.ngram_links(table).collect()) == brute(rows, 4, 85)


def test_segments_are_the_set_in_its_order():
    draw = np.random.default_rng(6)
    for n in (0, 1, 3, 500):
        hashes = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        frequent = np.sort(hashes[: n // 5])
        parts = setjoin.segments(hashes, frequent)
        assert sorted(x for _, p in parts for x in p.tolist()) == hashes.tolist()
        assert all(len(p) and i <= setjoin.FRAGMENTS for i, p in parts) and len({i for i, _ in parts}) == len(parts)
        assert all(int(x) >> 61 == i for i, p in parts if i < setjoin.FRAGMENTS for x in p.tolist())


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(8)
    frequent = np.array(sorted(rng.sample(range(300), 60)), np.uint64)
    often = np.array([rng.randrange(3, 90) for _ in frequent], np.int32)
    for _ in range(400):
        base = set(rng.sample(range(300), rng.randrange(1, 80)))
        other = set(base)
        for x in rng.sample(range(300), rng.randrange(0, 12)):
            other ^= {x}
        if other and 100 * len(base & other) >= 85 * len(base | other):
            a, b = (set(setjoin.prefix(np.array(sorted(s), np.uint64), 85, frequent, often).tolist()) for s in (base, other))
            assert a & b


def test_bitmap_holds_every_key_met_again(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BUCKET_KEYS", 64)
    monkeypatch.setattr(setjoin, "GATHERED", 100)
    draw = np.random.default_rng(7)
    keys = draw.integers(0, 1 << 64, 5000, dtype=np.uint64)
    again = keys[:600]
    lists = [*np.array_split(keys, 90), *np.array_split(again, 11), np.zeros(0, np.uint64)]
    sets = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(lists)], "node long, n int, keys binary").repartition(5)
    got = setjoin.shared_keys(sets).collect()
    wanted = {int(k) for k in again.view(np.int64)}
    met = Counter(r.key for r in got if r.key in wanted)
    assert set(met) == wanted and set(met.values()) == {2}
    assert len(got) - 1200 < 1200  # few others pass in vain
    assert all(np.uint64(r.key & (2**64 - 1)) == lists[r.node][r["at"]] and r.n == len(lists[r.node]) for r in got)


def test_pairs_of_many_common_keys_are_made_few_times(spark, monkeypatch):
    """Sets of one family share nearly all keys, but no two are similar enough: a pair comes of its first common key, not of each, and none is lost."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from skyledger.llm import setjoin

    percent, size, family = 80, 400, 16
    rng = np.random.default_rng(5)
    common = np.unique(rng.integers(0, 1 << 62, size, dtype=np.int64))
    own = [np.unique(np.concatenate([rng.permutation(common)[: size - 45], rng.integers(0, 1 << 62, 45, dtype=np.int64)])).view(np.uint64) for _ in range(family)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys = [setjoin.prefix(x, percent, *none) for x in own]
    rows = [(int(k), node, node, len(own[node]), at) for node, ks in enumerate(keys) for at, k in enumerate(ks.view(np.int64))]
    odd = [(node, *(int(x) for x in setjoin.parities(own[node]))) for node in range(family)]
    monkeypatch.setattr(setjoin, "_over", lambda percent: F.lit(0))  # the parities alone would drop some
    seen, kind = [], type(spark.range(1))
    plain = kind.distinct

    def distinct(self):
        if "score" not in self.columns:
            return plain(self)
        seen.append(Observation())
        return plain(self.observe(seen[-1], F.count(F.lit(1)).alias("rows")))

    monkeypatch.setattr(kind, "distinct", distinct)
    held = spark.createDataFrame(rows, "key long, node long, root long, n int, at int")
    sides = spark.createDataFrame(odd, ", ".join(["node long", *(f"{c} long" for c in setjoin.ODD)]))
    got = {(r["a"], r["b"]) for r in setjoin._apart_pairs(held, sides, percent).collect()}

    def reached(a, b):
        n, m, both = len(own[a]), len(own[b]), np.intersect1d(keys[a], keys[b])
        least, beyond = -(-(n + m) * percent // (100 + percent)), max(-(-n * percent // 100), -(-m * percent // 100)) - 1
        at = min((int(np.flatnonzero(keys[a] == k)[0]), int(np.flatnonzero(keys[b] == k)[0])) for k in both)
        return min(n - at[0], m - at[1]) >= least and len(both) + beyond >= least

    every = {(a, b) for a in range(family) for b in range(a)}
    want = {(a, b) for a, b in every if reached(a, b)}
    assert {(max(x), min(x)) for x in got} == want and len(want) > 50
    meetings = sum(len(np.intersect1d(keys[a], keys[b])) for a, b in every)
    assert seen[0].get["rows"] < 3 * len(every) < meetings / 5
