"""The ten operators on small fixtures: odd rows, brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import bitsliced, bpe, exact_dedup, langid, neardups, packing, setjoin, sharding, simhash, token_files, toxicity, urlfilter
from skyledger.llm.components import components
from skyledger.llm.shared import held_out
from skyledger.llm.vocabularies import vocabulary

DATA = "/root/testdata/sf0.001"
#: Columns of an operator's own, which a table may have too.
CLASH = "digest string, fp int, a int, b int, node int, slot int, shard int, size int, score int, n int, keep_id int, gone_id int, root int, lead int, which int, label string, _text string, rule string"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, blank, long and repeated rows, equal texts, and columns whose names clash."""
    texts = [(1, "one two three four five"), (2, "one two three four five"), (3, None), (4, ""), (5, "  \n"), (6, LONG), (7, LONG), (None, "no id"), (8, "x"), (8, "x"), (9, "é ß 漢字 <|endoftext|> 12"), (10, None)]
    rows = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in (c.split() for c in CLASH.split(", "))))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_shards(odd):
    rows = sharding.shard_documents(odd, shards=4).collect()
    assert len(rows) == 12
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].size == 1 and by_id[3].text_crc32 == 0 and by_id[6].size == len(LONG) + 1
    assert all(r.text_crc32 == zlib.crc32("x".encode()) for r in rows if r.doc_id == 8)
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def shard_units(docs, shards):
    rows = sharding.slot_rows(docs)
    return sharding.unit_stats(sharding.in_units(rows, sharding.large_groups(rows, shards)))


def test_shards_are_even_and_maps_move_little(spark, docs):
    rows = sharding.shard_documents(docs, shards=16).collect()
    loads, mean = Counter(), sum(r.size for r in rows) / 16
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
    assert max(loads.values()) < mean + max(r.size for r in rows)
    key = lambda r: (r.vslot, r.text_key, r.part)
    stats = {key(r): r.bytes for r in shard_units(docs, 8).collect()}
    first = sharding.edited_map(sharding.first_map(spark, 8), shard_units(docs, 8), 8)
    more = sharding.edited_map(first, shard_units(docs, 9), 9)
    a, b = ({key(r): r.shard for r in m.collect()} for m in (first, more))
    moved = [k for k in b if k in stats and a.get(k) != b[k]]
    assert stats.keys() <= a.keys() and set(b[k] for k in stats if k in b) == set(range(9)) and len(moved) < len(stats) / 2
    assert more.first().version == 3
    assert stats.keys() <= {key(r) for r in sharding.edited_map(first.limit(0), shard_units(docs, 8), 8).collect()}


def test_hot_text_is_split(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text over and over").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    loads = [r.s for r in sharding.shard_documents(hot, shards=16).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 16 and max(loads) < 1.15 * sum(loads) / 16


def test_small_groups_beside_a_hot_one_stay_whole(spark):
    """A slot's small texts stay together when a hot text of the same slot is cut; so do large groups that a shard can hold."""
    big = "the same text over and over"
    slot = spark.range(1).select(F.pmod(F.xxhash64(F.lit(big)), F.lit(sharding.SLOTS)).alias("s")).first().s
    near = spark.range(200_000).select(F.concat(F.lit("small "), F.col("id")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(sharding.SLOTS)) == slot).limit(5)
    names = [r.t for r in near.collect()]
    rows = [big] * 2000 + names * 12 + ["a large one"] * 300 + [f"filler {i}" for i in range(4000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sharding.shard_documents(table, shards=16).join(table, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n"), F.first("virtual_slot").alias("v")).collect()
    by_text = {r.text: r for r in got}
    assert by_text[big].n > 4 and all(r.n == 1 for r in got if r.text != big) and len(names) == 5
    assert all(by_text[t].v == slot for t in names)


def test_map_versions(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    a = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(docs, shards=4, map_path=path).collect()}
    b = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(docs, shards=5, map_path=path).collect()}
    assert {v for _, v in a.values()} == {2} and {v for _, v in b.values()} == {3} and {s for s, _ in b.values()} == set(range(5))
    assert sum(a[i][0] != b[i][0] for i in a) < len(a) / 2
    assert sharding.read_map(spark, path).first().version == 3
    assert sharding.read_map(spark, path, 1).count() == sharding.SLOTS


def weak_digest(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 1))


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, weak_digest])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, odd, digest, keep, monkeypatch):
    """Which rows are grouped is told by their texts, also where digests of different texts are equal and memtables hold few rows."""
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 3)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, f"text {i % 20}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    want, pick = Counter(), min if keep == "min" else max
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        best = pick((j for j in same if j is not None), default=None)
        want[i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(table, keep=keep, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_runs_and_filters():
    """A memtable is sorted and puts equal digests together; a filter admits all that it holds and few others."""
    rng = random.Random(22)
    raw = [rng.randbytes(32) for _ in range(2000)] + [bytes(32), b"\0" * 31 + b"a", b"a" + b"\0" * 31]
    held = np.frombuffer(b"".join(raw + raw[:50]), "S32")
    ids = np.arange(len(held))
    for keep, best in (("min", lambda i: i), ("max", lambda i: i if i >= 50 else 2003 + i)):
        digests, kept, known, counts = exact_dedup.memtable(held, ids, ids != 3, np.ones(len(held), np.int64), keep)
        assert [d.ljust(32, b"\0") for d in digests.tolist()] == sorted(raw) and counts.sum() == len(held)
        at = {d.ljust(32, b"\0"): k for d, k in zip(digests.tolist(), range(len(digests)), strict=True)}
        assert all(kept[at[d]] == (2006 if i == 3 and keep == "min" else best(i)) for i, d in enumerate(raw)) and known.all()
    filter_ = exact_dedup.filter_of(held)
    assert exact_dedup.may_hold(filter_, held).all()
    assert exact_dedup.may_hold(filter_, np.frombuffer(rng.randbytes(32 * 5000), "S32")).mean() < 0.01


def test_merge_index_in_batches(spark, tmp_path):
    index = exact_dedup.MergeIndex(spark, f"{tmp_path}/index", keep="max")
    assert index.table().count() == 0
    batches = [[(1, "a"), (2, "b")], [(3, "a"), (4, None)], [(5, ""), (6, "c"), (6, "c")]]
    corpus = spark.createDataFrame([r for b in batches for r in b], "doc_id long, text string")
    for rows in batches:
        index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = lambda: sorted((r.keep_id, r.n) for r in index.table().collect())
    assert whole() == [(2, 1), (3, 2), (5, 2), (6, 2)]
    index.compact()
    assert len(index._runs()) == 1 and whole() == [(2, 1), (3, 2), (5, 2), (6, 2)] and {r.level for r in index.runs().collect()} == {1}
    left = index._runs()[0]
    index.add(corpus.limit(0))
    assert left in index._runs() and whole() == [(2, 1), (3, 2), (5, 2), (6, 2)]
    assert [(r.keep_id, r.n) for r in index.lookup("a").collect()] == [(3, 2)] and index.lookup("zz").count() == 0
    new = spark.createDataFrame([(9, "a"), (10, "zz"), (11, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in index.seen(new, corpus).collect()) == [(9, 3), (11, 5)]


def test_drop_copies(odd):
    left = exact_dedup.drop_copies(odd)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 5, 6, 8, 8, 9] and left.columns == odd.columns


def test_bpe_is_the_library(spark, odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for table in (odd, docs):
        plain = Counter((r.doc_id, r.text or "") for r in table.collect())
        want = Counter()
        for (i, t), n in plain.items():
            ids = library.encode(t, add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
        got = bpe.encode_documents(table, vocabulary("byte_bpe_50k.json"))
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert bpe.encode_documents(odd.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_automaton_accepts_one_path():
    """On a small merge list: the encoding by merges is the only sequence that the automaton accepts."""
    letters = {i: bytes([97 + i]) for i in range(3)}
    rng = random.Random(11)
    for _ in range(30):
        labels, merges = dict(letters), []
        for _ in range(8):
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] in labels.values():
                continue
            labels[len(labels)] = labels[u] + labels[v]
            merges.append((u, v, len(labels) - 1))
        automaton = bpe.MergeAutomaton(labels, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            ids = [w - 97 for w in word]
            while True:
                ranked = [(k, i) for i in range(len(ids) - 1) for k, (u, v, _) in enumerate(merges) if (ids[i], ids[i + 1]) == (u, v)]
                if not ranked:
                    break
                k, _ = min(ranked)
                u, v, made = merges[k]
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [u, v]:
                        out.append(made)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert automaton.encode(word) == ids and automaton.decode(ids) == word


def test_table_cells_are_those_of_the_gadgets():
    """On random merge lists: rows built by putting the gadgets into an explicit automaton, state by state, are the rows of the table."""
    rng = random.Random(23)
    for _ in range(40):
        labels, merges = {i: bytes([97 + i]) for i in range(3)}, []
        for _ in range(10):
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                labels[len(labels)] = labels[u] + labels[v]
                merges.append((u, v, len(labels) - 1))
        rows = {t: set(range(3)) for t in range(3)}  # token -> tokens that can follow it
        start = set(range(3))
        for u, v, made in merges:
            if v in rows.get(u, ()):
                rows[made] = set(rows[v])
                rows[u].discard(v)
                for row in rows.values():
                    if u in row:
                        row.add(made)
                start.add(made) if u in start else None
        automaton = bpe.MergeAutomaton(labels, merges)
        there = {automaton.ids[w] for w in automaton.ids}
        assert there == set(rows) and start == there
        for before in there:
            got = {t for t in there if automaton.next_state(automaton.state[before], t) != bpe.DEAD}
            assert got == rows[before] & there, (merges, before)
            assert all(automaton.next_state(automaton.state[before], t) == automaton.state[t] for t in got)


def shared_staged(df):
    from skyledger.llm.shared import staged

    return staged(df, "manifest")


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, odd, docs, tmp_path, bits):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for k, table in enumerate((odd, docs, odd.limit(0))):
        folder = f"file://{tmp_path}/{k}"
        written = token_files.write_token_files(table, vocabulary("word_bpe_49k.json"), folder, end_id=2, bits=bits)
        manifest = shared_staged(written)
        sizes = manifest.collect()
        plain = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        want = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in plain]
        got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [i for i, _ in plain]
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids)) for (i, _), ids in zip(plain, want, strict=True))
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
        assert sum(r.n_ids for r in sizes) == sum(map(len, want))


def brute_components(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    linked = {frozenset(p) for p in pairs}
    want = brute_components({x for p in pairs for x in p}, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(v, v) == r for v, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("paired", [64, 2])
def test_simhash_links(spark, paired):
    rng = random.Random(4)
    fps = set()
    for _ in range(5):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = brute_components(fps, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, paired)).collect()}
    assert all(got.get(f, f) == want[f] for f in fps)


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_documents(odd, docs):
    for table in (odd, docs.limit(60)):
        table = table.cache()
        plain = [(r.doc_id, slow_fingerprint(r.text or "")) for r in table.collect()]
        roots = brute_components({f for _, f in plain}, lambda a, b: bin(a ^ b).count("1") <= 2)
        least = {}
        for i, f in plain:
            if i is not None:
                least[roots[f]] = min(least.get(roots[f], i), i)
        want = Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in plain)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(table).collect()) == want
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def made_words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]


def changed_words(rng):
    """Ever more single words changed."""
    for _ in range(4):
        base = made_words(rng, 300)
        for k in range(6):
            copy = list(base)
            for _ in range(2 * k):
                copy[rng.randrange(300)] = made_words(rng, 1)[0]
            yield copy


def five_kinds(rng):
    """Single words changed, end cut, start cut, a passage put in, and texts of under twenty words, all about the bound of 0.8."""
    for n in (9, 12, 19, 29, 60, 104, 240):
        for _ in range(6):
            words, cut = made_words(rng, n), max(1, (n - 4) // 5)
            changed = list(words)
            for at in rng.sample(range(n), max(1, n // 50)):
                changed[at] = made_words(rng, 1)[0]
            middle = n // 2
            yield from (words, changed, words[:-cut], words[cut:], [*words[:middle], *made_words(rng, max(1, n // 6)), *words[middle:]])


def equal_words(rng):
    """The smallest id of one set of words is no near copy of the others, which are of each other."""
    for _ in range(3):
        words = made_words(rng, 100)
        other = rng.sample(words, 100)
        yield from (words, other, [*other[:50], other[51], other[50], *other[52:]], [*other[:-1], "new"])


def repetitive(rng):
    """A fifth of new words more than doubles the distinct words."""
    for _ in range(3):
        words = rng.choices(made_words(rng, 200), k=1000)
        yield from (words, words + made_words(rng, 240))


def short_families(rng):
    """Texts with most words in common and smaller ids stand between two near copies of nine and eight words."""
    for _ in range(10):
        words = made_words(rng, 9)
        yield from ([*words[:4], *made_words(rng, 1), *words[5:]] for _ in range(6))
        yield from (words, words[:8])


def crowd(rng):
    """Many near copies of one text, so that its keys are hot."""
    base = made_words(rng, 80)
    yield from ([*base[:k], *made_words(rng, 1), *base[k + 1 :]] for k in range(40))


def test_near_copies(spark, odd, monkeypatch):
    """What is left is one row, that of the smallest id, of each group that all pairs of texts make; rows of one id are documents of their own."""
    from skyledger.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 16)
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    rng, rows = random.Random(12), []
    for family in (changed_words, five_kinds, equal_words, repetitive, short_families, crowd):
        rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate(family(rng))]
    one, two = made_words(rng, 60), made_words(rng, 60)
    near = " ".join([*one[:-1], "new"])
    rows += [(9001, " ".join(one)), (9005, near), (9005, " ".join(two)), (None, near), (None, "alone with no id"), (None, " ".join(two))]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    roots = brute_components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = {}
    for i, root in roots.items():
        want[root] = min(want.get(root, (9, 9)), (rows[i][0] is None, rows[i][0] or 0))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("near_node", F.lit(1)).withColumn("node", F.lit(2)).withColumn("key", F.lit(3))
    left = neardups.drop_near_copies(table)
    got = left.collect()
    assert left.columns == table.columns and len(want) < len(rows) * 0.7
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(want.values())
    kept = {(r.doc_id, r.text) for r in got}
    assert (9005, " ".join(two)) in kept and (9005, near) not in kept and (None, "alone with no id") in kept and (None, near) not in kept
    assert neardups.drop_near_copies(table.limit(0)).count() == 0


def slow_packing(lengths, sizes, overhead):
    """Best fit, longest first, ties as they come; a new bin has the size with the least cost per token that the longest waiting pieces would fill."""
    waiting, bins = sorted(range(len(lengths)), key=lambda i: -lengths[i]), []
    while waiting:
        i = waiting.pop(0)
        fits = [b for b in bins if b["size"] - b["n"] >= lengths[i]]
        if fits:
            own = min(fits, key=lambda b: (b["size"] - b["n"], bins.index(b)))
        else:
            costs = []
            for size in sorted(s for s in sizes if s >= lengths[i]):
                n = lengths[i]
                for j in waiting:
                    if n + lengths[j] <= size and lengths[j]:
                        n += lengths[j]
                costs.append(((size + overhead) / n if n else 0, size))
            own = {"size": min(costs)[1], "n": 0, "pieces": []}
            bins.append(own)
        own["pieces"].append(i)
        own["n"] += lengths[i]
    return [(b["pieces"], min(s for s in sizes if s >= b["n"])) for b in bins]


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, sizes = Tokenizer.from_file(path), (64, 256, 1024)
    for table, end in ((odd, 0), (odd, None), (docs, 0), (odd.where("doc_id IN (3, 4)"), None), (odd.where("doc_id = 8"), 0), (odd.where("doc_id = 1"), 0)):
        rows = packing.pack(table, path, sizes=sizes, end_id=end, group_pieces=50).cache()
        plain = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [end] * (end is not None))) for r in table.collect())
        found, bins, room = {}, Counter(), {}
        for r in rows.collect():
            bins[r.bin_id] += r.length
            room[r.bin_id] = r.bin_size
            assert r.bin_start + r.length <= r.bin_size and len(r.ids) == r.length
            found.setdefault((r.doc_id, r.text_key, r.piece, r.start), []).append(tuple(r.ids))
        whole = Counter()
        for (i, key, piece, start), copies in sorted(found.items(), key=lambda x: (str(x[0][:2]), x[0][2])):
            assert len(set(copies)) == 1 and start == piece * 1024
            whole[i, key, len(copies)] = whole.get((i, key, len(copies)), ()) + copies[0]
        assert Counter({(i, ids): n for (i, _, n), ids in whole.items()}) == plain
        assert all(room[b] == next(s for s in sizes if s >= n) for b, n in bins.items())
        told = {r.bin_id: r for r in packing.sequences(rows).collect()}
        assert {b: r.n for b, r in told.items()} == bins and all(len(r.ids) == r.n for r in told.values())
        assert all(told[r.bin_id].ids[r.bin_start : r.bin_start + r.length] == r.ids for r in rows.collect())
    assert packing.pack(odd.limit(0), path).count() == 0
    assert set(packing.pack(odd, path, keep_ids=False).columns) == {"doc_id", "text_key", "piece", "start", "length", "bin_id", "bin_start", "bin_size", "ids_crc32"}


def test_packing_is_the_same_however_files_are_split(spark, odd):
    """Repeated rows, too, lie in the same bins in a second run; ids and their crc32 agree."""
    rows = [(1, "one two three " * 50)] * 40 + [(i, f"text number {i} " * (i % 9)) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    own = ["doc_id", "text_key", "piece", "start", "length", "bin_id", "bin_start", "bin_size"]
    whole = packing.pack(table.coalesce(1), vocabulary("byte_bpe_50k.json"), sizes=(64, 128), group_tokens=2000, group_pieces=50).collect()
    split = packing.pack(table.repartition(7), vocabulary("byte_bpe_50k.json"), sizes=(64, 128), group_tokens=2000, group_pieces=50, keep_ids=False).collect()
    assert Counter(tuple(r[c] for c in own) + (zlib.crc32(np.array(r.ids, "<i4").tobytes()),) for r in whole) == Counter(tuple(r[c] for c in own) + (r.ids_crc32,) for r in split)
    assert len({r.bin_id >> 40 for r in whole if r.doc_id == 1 and r.piece == 0}) > 1


@pytest.mark.parametrize("sizes", [(1000,), (250, 500, 1000), (100, 900, 1000, 1700)])
def test_packing_against_a_slow_best_fit(sizes):
    rng = random.Random(21)
    for n in (0, 1, 7, 150):
        lengths = np.array([rng.choice([0, rng.randint(1, 99), rng.randint(1, sizes[-1]), 77]) for _ in range(n)], np.int64)
        bins, places, size = packing.packed(lengths, sizes=sizes, overhead=16)
        got = {}
        for i in np.lexsort((np.arange(n), places, bins)).tolist():
            got.setdefault(int(bins[i]), []).append(i)
        want = slow_packing(lengths.tolist(), sizes, 16)
        assert [(sorted(lengths[p].tolist()), int(size[p[0]])) for _, p in sorted(got.items())] == [(sorted(lengths[p].tolist()), s) for p, s in want]


def test_packing_of_empty_texts_alone():
    bins, places, size = packing.packed(np.zeros(3, np.int64), sizes=(1024, 2048))
    assert bins.tolist() == places.tolist() == [0, 0, 0] and size.tolist() == [1024] * 3


def test_packing_against_a_plain_best_fit():
    rng = random.Random(8)
    lengths = np.array([rng.randint(0, 1000) for _ in range(400)])
    bins, places, size = packing.packed(lengths, sizes=(1000,))
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(1000 - n)
    assert len(set(bins.tolist())) == len(free)
    for b in set(bins.tolist()):
        own = sorted((places[i], lengths[i]) for i in np.nonzero(bins == b)[0])
        assert all(p + n <= q for (p, n), (q, _) in zip(own, own[1:], strict=False))
    mixed = packing.packed(lengths, sizes=(250, 500, 1000))
    assert lengths.sum() / sum({b: s for b, s in zip(mixed[0], mixed[2], strict=True)}.values()) >= lengths.sum() / (1000 * len(free)) - 0.02


def test_language_of_words():
    rng = random.Random(1)
    stems = {"aa": "kalo miru tane sola", "bb": "strunk pfelt gramz wolst"}
    text = lambda lang: " ".join(rng.choice(stems[lang].split()) + rng.choice(stems[lang].split()) for _ in range(30))
    pieces = ["▁" + c for c in "kmtsspgw"] + list("abcdefghijklmnopqrstuvwxyz") + ["kalo", "lo", "miru", "ta", "ne", "strunk", "felt", "ol", "st", "▁ka", "ram"]
    langs, table = langid.fit(pieces, {lang: [text(lang) for _ in range(20)] for lang in stems})
    judge = langid.Judge(pieces, langs, table)
    names, scores = judge.judge([text("aa"), text("bb"), None, "", "12 !? ½ ²", "x" * 500])
    assert names[:5] == ["aa", "bb", "und", "und", "und"] and scores[2:5] == [0.0] * 3 and min(scores[:2]) > 0.9 and names[5] in langs


def test_segmentations_are_summed():
    lattices = langid.Lattices(["a", "b", "ab", "▁a"])
    table = np.array([[0.2], [0.3], [0.1], [0.25], [1e-7], [0.0]])
    total = np.exp(lattices.log_sums(lattices.build(["ab", "ab"]), table)[0, 0])
    # a word's first piece takes the word-start form where there is one: ▁a + b, or ab
    assert abs(total - (0.25 * 0.3 + 0.1)) < 1e-12


def test_segmentations_are_those_that_enumeration_gives():
    """Sums and expected counts over all ways to cut a word, against a list of all of them; long words do not vanish."""
    rng = np.random.default_rng(4)
    pieces = ["a", "b", "ab", "ba", "aab", "bb", "▁a", "▁ab", "▁bab"]
    lattices = langid.Lattices(pieces)
    table = rng.uniform(0.01, 0.3, (len(pieces) + 2, 2))
    table[lattices.absent] = 0
    for word in ("a", "ab", "abba", "babaab", "bababababbab"):
        size, ways = len(word), []
        for cuts in range(1 << (size - 1)):
            ends = [i + 1 for i in range(size - 1) if cuts >> i & 1] + [size]
            parts = [word[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            numbers = [lattices.number.get("▁" + p, lattices.number.get(p)) if i == 0 else lattices.number.get(p) for i, p in enumerate(parts)]
            if None not in numbers:
                ways.append((numbers, np.prod([table[k] for k in numbers], 0)))
        total = sum(p for _, p in ways)
        ids = lattices.build([word, word])
        assert np.allclose(np.exp(lattices.log_sums(ids, table)), [total, total])
        counts = lattices.expected(ids, table[:, :1], np.array([1.0, 2.0]))
        want = np.zeros(len(pieces) + 2)
        for numbers, p in ways:
            np.add.at(want, numbers, 3 * p[0] / total[0])
        assert np.allclose(counts, want)
    # of a long word the sum falls by a steady factor per letter, with no run of letters cut off
    logs = [lattices.log_sums(lattices.build(["ab" * n]), table)[0] for n in (50, 2000, 2001, 4001)]
    assert np.isfinite(logs).all() and np.allclose(logs[3] - logs[2], 2000 * (logs[2] - logs[1]), rtol=1e-6)
    long = lattices.expected(lattices.build(["ab" * 300]), table[:, :1], np.ones(1))
    assert np.isfinite(long).all() and abs(sum(long[k] * len(p.strip("▁")) for k, p in enumerate(pieces)) - 600) < 1e-6


def test_language_operator(spark, odd, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(big, vocabulary("piece_bpe_32k.model"), ~held_out(F.col("doc_id"))).withColumn("out", held_out(F.col("doc_id"))).join(big.select("doc_id", "lang"), "doc_id").where("out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    got = langid.identify(odd, vocabulary("piece_bpe_32k.model"), F.lit(True)).collect()
    assert len(got) == 12 and {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 10)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(odd.limit(0), vocabulary("piece_bpe_32k.model"), F.lit(True)).count() == 0
    kept = langid.language_filter(odd, vocabulary("piece_bpe_32k.model"), F.lit(True))
    assert kept.columns == odd.columns and not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}


def test_toxicity(spark, odd):
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(80))
    bad = ["grumblefoo", "snarkwit", "dolthead"]

    def spiked(words):
        text = plain().split()
        text[rng.randrange(80)] = rng.choice(words)
        return " ".join(text)

    texts = [spiked(bad) for _ in range(150)] + [plain() for _ in range(300)]
    model = toxicity.fit(texts, [1] * 150 + [0] * 300)
    judge = toxicity.Judge(model.scale(), model.bias)
    right = sum(judge.score(spiked(bad)) >= 0.3 for _ in range(100)) + sum(judge.score(plain()) < 0.3 for _ in range(100))
    misspelt = sum(judge.score(spiked(["grumblefooo", "snarkwitt", "doltheadd"])) >= 0.3 for _ in range(100))
    assert right >= 190 and misspelt >= 80
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.toxicity(odd, marks, F.lit(True)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity(odd.limit(0), labels, F.lit(True)).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0), F.lit(True)).columns == odd.columns


def test_toxicity_gradients(monkeypatch):
    """The derivatives that training uses are those of the loss, by finite differences: of vectors, softmax weights and bias."""
    rng = np.random.default_rng(3)
    texts, y = ["one two three four five six seven eight", "you fool", "", "a b c d e f g nine ten", "fool on the hill"], np.array([1.0, 1, 0, 0, 0])
    balance, bags = np.array([1.2, 0.8, 1, 1, 0.5]), toxicity.Bags(texts)
    model = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 1, (2, toxicity.DIM)), -1.0)
    loss, pull, by_weights, by_bias = toxicity.gradients(bags, y, balance, model)
    at = lambda: toxicity.gradients(bags, y, balance, model)[0]
    by_vector = lambda b, d: pull[b] * (model.weights[1] - model.weights[0])[d]
    for table, index, want in [(model.vectors, (b, d), by_vector(b, d)) for b in toxicity.buckets("fool")[:4] for d in (0, 5)] + [(model.weights, (k, d), by_weights[k, d]) for k in (0, 1) for d in (2, 7)]:
        kept = table[index]
        table[index] = kept + 1e-5
        above = at()
        table[index] = kept - 1e-5
        assert abs((above - at()) / 2e-5 - want) < 1e-6
        table[index] = kept
    model.bias += 1e-5
    assert abs((at() - loss) / 1e-5 - by_bias) < 1e-3
    scale, clean = model.scale(), []
    for text in texts:  # the loss itself, passage by passage
        values = np.array([scale[toxicity.buckets(w)].mean() for w in toxicity.words_of(text)])
        clean.append(np.prod(1 / (1 + np.exp(toxicity.passage_means(values) + model.bias))))
    assert abs((balance * -np.log(np.where(y == 1, 1 - np.array(clean), clean))).mean() - at()) < 1e-9


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/", "http://a.www.example.com/en/x", "http://badexample.com/en/", "http://x.net/es/1", "http://x.net/de/1", "ftp://com/", "http://com", "no scheme", None, "", "a://b?c/d", "http://h#/p", "x://" + "a" * 5000]
    table = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = urlfilter.judge_urls(table.unionByName(table), RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 2 * len(urls) and len({(r.page_id, r.verdict, r.lm_score) for r in rows}) == len(urls)
    assert [got[i].rule for i in range(9)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, "com/", None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("example.com", "/en/1", "block") and got[1].verdict == "allow"
    assert all((got[i].host, got[i].path) == ("", "") for i in (8, 9, 10)) and (got[11].host, got[11].path, got[12].host, got[12].path) == ("b", "", "h", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urlfilter.judge_urls(table.limit(0), RULES).count() == 0


def test_url_model():
    good, bad = [f"site{i}.org/en/page{i}" for i in range(200)], [f"win-casino{i}.bet/free-spin{i}" for i in range(200)]
    ratio = urlfilter.fitted(good, bad)
    assert ratio.verdict("site999.org/en/page7") == "allow" and ratio.verdict("casino-win.bet/free-spin") == "block"
    for context in ("", "zz", "site", "\x02\x02"):
        assert abs(sum(ratio.accepted.probability(context, chr(c)) for c in range(1024)) - 1) < 1e-6
    assert urlfilter.fitted(good, []) is None


def test_url_model_learns_from_all_addresses(spark):
    """Scores are those of models of every address learnt from, of over 4000 per verdict, and the threshold is the best of all cuts."""
    rng = random.Random(16)
    pages = [f"http://{''.join(rng.choices('abcdefgh', k=8))}.{end}" for end in ("com/p", "net/es/q", "org/x") for _ in range(5500)]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    texts = spark.createDataFrame(sorted({(p[7:],) for p in pages}), "text string")
    held = {r.text for r in texts.where(urlfilter.held_out_address(F.col("text"))).collect()}
    kinds = [sorted({p[7:] for p in pages if end in p}) for end in (".com/", ".net/es/")]
    assert min(map(len, kinds)) > 5000
    ratio = urlfilter.Ratio(*(urlfilter.MarkovModel([t for t in k if t not in held]) for k in kinds))
    got = urlfilter.judge_urls(table, RULES).where("rule IS NULL").collect()
    assert len(got) == 5500 and all(abs(r.lm_score - ratio.score(r.host + r.path)) < 1e-8 for r in got)
    tried = [[ratio.score(t) for t in k if t in held] for k in kinds]
    assert max(tried[1]) < min(tried[0])
    middle = (max(tried[1]) + min(tried[0])) / 2
    assert all(r.verdict == ("allow" if r.lm_score >= middle else "block") for r in got)


def test_url_tables_do_not_pass_the_driver(spark, monkeypatch):
    """Tables that grow with the input are joined by merge, however small their files; one address has thousands of rows."""
    rng = random.Random(17)
    pages = [f"http://{''.join(rng.choices('abcdefgh', k=8))}.{end}" for end in ("com/p", "net/es/q", "org/x") for _ in range(100)]
    table = spark.createDataFrame(list(enumerate([*pages, *[None] * 2100])), "page_id long, url string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = {}, urlfilter.staged
    monkeypatch.setattr(urlfilter, "staged", lambda df, name: (plans.update({name: plan(df)}), write(df, name))[1])
    few, all_rows = urlfilter.judge_urls(table.limit(300), RULES), urlfilter.judge_urls(table, RULES)
    assert "url-scored" in plans and not [k for k, v in plans.items() if "BroadcastExchange" in v and k != "url-cuts"]  # cuts: a row per task
    assert "BroadcastExchange" not in plan(few)
    rows = lambda df: {r.page_id: (r.host, r.path, r.rule, r.verdict, r.lm_score) for r in df.collect()}
    got, want = rows(all_rows), rows(few)
    assert all_rows.count() == 2400 and len(want) == 300 and {k: v for k, v in got.items() if k < 300} == want
    assert len({got[k] for k in range(300, 2400)}) == 1
    texts = [(p[7:], p[-2:]) for p in pages]
    held = {r.text for r in spark.createDataFrame(texts, "text string, end string").where(urlfilter.held_out_address(F.col("text"))).collect()}
    ratio = urlfilter.Ratio(*(urlfilter.MarkovModel([t for t, e in texts if e == end and t not in held]) for end in ("/p", "/q")))
    assert all(abs(got[k][4] - ratio.score(texts[k][0])) < 1e-8 for k in range(200, 300)) and abs(got[300][4] - ratio.score("")) < 1e-8


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    x[100:160] = x[100]  # ties
    x[200] = 0
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [None] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [float("inf")] * 16, 0), (1200, [], 0), (1250, [0.5] * 3, 0), (None, [0.1] * 16, 0), (50, x[50].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    q = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        others = [(-int(q[j] @ q[i]), j) for j in range(400) if j != i]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted(others)[:5])]
    got = bitsliced.top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert bitsliced.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(1)
    x = rng.integers(-60, 60, (130, 9))
    block = bitsliced.SlicedBlock(np.arange(130), x)
    weights, negative = rng.integers(0, 30, 9), rng.random(9) < 0.5
    slices = block.coarse(weights, negative)
    top = (x - x.min()) >> block.drop
    want = (np.where(negative, (1 << bitsliced.COMPONENT_BITS) - 1 - top, top) * weights).sum(1)
    bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert ((bits << np.arange(len(bits))[:, None]).sum(0) == want).all()
    assert bitsliced._kth(slices, block.there, 7) == np.sort(want)[-7]


def slow_stage(name, rows, spark, table, folder):
    """A stage's rows by brute force: rows are (doc_id, text)."""
    trainable = ~held_out(F.col("doc_id"))
    if name == "language_id":
        pieces = langid.read_pieces(vocabulary("piece_bpe_32k.model"))
        judge = langid.Judge(pieces, *langid.fit(pieces, langid.training_texts(table, trainable)))
        names, scores = judge.judge([t for _, t in rows])
        return [r for r, n, x in zip(rows, names, scores, strict=True) if n != "und" and x >= langid.LEAST_SCORE]
    if name == "toxicity":
        model = toxicity.fit(*toxicity.training_rows(table, spark.read.parquet(f"{folder}/labels.parquet"), trainable))
        judge = toxicity.Judge(model.scale(), model.bias)
        return [r for r in rows if judge.score(r[1]) < 0.3]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    if name == "exact_dedup":
        best = {}
        for i, t in rows:
            best.setdefault(t or "", []).append(i)
        return [(i, t) for i, t in rows if i == least(best[t or ""])]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    groups = {}
    for i, root in brute_components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])).items():
        groups.setdefault(root, []).append(rows[i][0])
    return [least(ids) for ids in groups.values()]


def test_pipeline(spark, odd, tmp_path):
    """Every stage against its brute-force version, on documents with odd rows among them; and the whole on an empty table."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder = f"file://{tmp_path}/sf"
    rng, plain = random.Random(31), spark.read.parquet(f"{DATA}/documents.parquet")
    text = plain.where("lang = 'en' AND length(text) > 400").orderBy("doc_id").first().text
    more = [(9001, text + " one more"), (9002, text), (9002, " ".join(made_words(rng, 30))), (None, text[:-2])]
    extra = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in more], plain.schema)
    plain.unionByName(odd.select(plain.columns)).unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == plain.columns, name
        rows, kept = ([(r.doc_id, r.text) for r in t.collect()] for t in (before, after))
        want = slow_stage(name, rows, spark, before, folder)
        got = [i for i, _ in kept] if name == "simhash_near_dedup" else kept
        assert 0 < len(want) < len(rows) or name == "toxicity", name
        assert Counter(got) == Counter(want) and not Counter(kept) - Counter(rows), name
        before = after
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    packed = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, before, folder).collect():
        packed[r.doc_id] += r.length
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packed == want
    none = f"file://{tmp_path}/none"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{none}/{table}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
