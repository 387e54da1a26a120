"""Decontamination, sharding, mixing, fingerprints, near duplicates and the language model against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossloom.llm import decontam, fingerprint, knlm, mixing, queries, sharding, simhash_dedup

SF = "/root/testdata/sf0.001"
WILD = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (5, " \n\t "), (6, "Ünï Ç " * 2000), (7, "one"), (8, "one two"), (9, "the " * 30), (9, "the " * 30)]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- decontamination


def slow_hits(text, items, window=13):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, low(text))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(word, low(t))
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    items = [(1, "The quick brown fox jumps over the lazy dog and runs far away from here now"), (2, "the quick brown fox"), (3, None), (4, "..."), (5, "THE QUICK, brown fox"), (10, "été à la plage"), (11, "the")]
    docs = [*WILD, (20, "x " + items[0][1] + " y The quick-brown fox. " + items[0][1]), (21, "Été à la plage été à la plage"), (22, "a the quick brown fox jumps over the lazy dog and runs far")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i or -1, *slow_hits(t, items)) for i, t in docs)
    for block in (decontam.BLOCK_WORDS, 25):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        monkeypatch.setattr(decontam, "CHUNK", block % 100 + 4)
        got = decontam.decontaminate(d, b).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(d, b.limit(0)).collect()} == {0}


def test_near_matches(spark):
    d = spark.createDataFrame([(1, "zebra alpha beta gamma delta one two three four five six seven eight nine"), (2, "nothing here zebra")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "zebra beta alpha gamma delta one two three four five six seven eight")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_near) for r in decontam.decontaminate(d, b).collect()} == {1: (0, 1), 2: (0, 0)}


def slow_near(text, item, window=13):
    """Spans of words inside runs that share at least 0.8 of a window's different words, from a shared word to one."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, v = re.findall(word, low(text)), re.findall(word, low(item))
    n, inside = min(window, len(v)), set()
    for j in range(len(v) - n + 1) if n else ():
        want = set(v[j : j + n])
        for i in range(len(w)):
            run = w[i : i + n]
            if w[i] in want and 5 * len(want & set(run)) >= 4 * len(want):
                inside |= set(range(i, i + max(k for k, x in enumerate(run) if x in want) + 1))
    return inside


def test_near_matches_with_the_rarest_words_edited(spark, monkeypatch):
    v = [f"v{i}" for i in range(30)]
    items = [(1, " ".join(v)), (2, "short one of five words"), (3, "zeta eta theta iota kappa lam mu nu xi omi pi rho sig"), (4, " ".join(v))]
    edit = lambda ws, *at: " ".join("edit" if i in at else x for i, x in enumerate(ws))
    third = items[2][1].split()
    # all words of the third item but those edited are common, so the edited ones are its rarest, or occur nowhere
    docs = [(100 + i, " ".join(third[2:])) for i in range(5)] + [(1, "... a b " + edit(v, 3, 14, 25) + " c"), (2, edit(third, 0)), (3, edit(third, 0, 1)), (4, edit(third, 0, 1, 5)), (5, "Short 1 of five words!"), (6, "words of one five"), (7, " ".join(third[:6] + ["more"] + third[6:])), (8, None), (9, "!")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: {str(k): s for k, x in items if (s := slow_near(t, x))} for i, t in docs}
    assert want[2] and want[3] and not want[4] and want[1].keys() == {"1", "4"} and want[5] and want[6] and want[7]
    for block, stretch in ((decontam.BLOCK_WORDS, 256), (45, 5)):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        monkeypatch.setattr(decontam, "STRETCH", stretch)
        for r in decontam.decontaminate(d, b).collect():
            spans = {}
            for m in r.near:
                spans.setdefault(m.item, set()).update(range(m.start, m.end))
            assert (r.doc_id, spans) == (r.doc_id, want[r.doc_id])
            assert (r.n_near, r.n_near_hit) == (len(spans), len(set().union(*spans.values())))


def no_python(monkeypatch, *modules):
    """From now on the tables that the modules write, too, must come from plans without Python. Returns the check."""
    seen = []

    def check(df):
        seen.append(df._jdf.queryExecution().toString())
        assert not re.search("Python|Pandas|Arrow|MapPartitions", seen[-1])

    for m in modules:
        monkeypatch.setattr(m, "written", lambda df, tag, f=m.written: (check(df), f(df, tag))[1])
    return check, seen


def test_decontamination_runs_no_python(spark, monkeypatch):
    check, seen = no_python(monkeypatch, decontam)
    check(queries.op2_decontamination(spark, SF))
    assert len(seen) > 4


# ---- sharding


def test_sharding(spark):
    got = queries.op3_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rendezvous_follows_weights_and_moves_little(spark):
    df = spark.range(40_000).withColumn("shard", F.lit("own"))
    got = sharding.assign_shards(df, "id", [1.0, 2.0, 0.0, 1.0])
    assert got.columns == ["id", "shard", "shard_"]
    n = Counter(r[0] for r in got.select("shard_").collect())
    assert n[2] == 0 and abs(n[1] / 40_000 - 0.5) < 0.02 and abs(n[0] / 40_000 - 0.25) < 0.02
    grown = sharding.assign_shards(got.withColumnRenamed("shard_", "a"), "id", [1.0, 2.0, 0.0, 1.0, 1.0], "b")
    moved = grown.filter("a <> b").agg(F.count("*"), F.min("b"), F.max("b")).first()
    assert moved[1] == moved[2] == 4 and abs(moved[0] / 40_000 - 0.2) < 0.02


def test_slots_of_equal_and_null_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [(3, 1)] * 4 + [(3, 2), (4, 1)], "k long, v long")
    got = sharding.number_slots(sharding.assign_shards(df, "k", [1.0]), "shard", ["k", "v"]).collect()
    assert sorted(r.slot for r in got) == list(range(11))
    assert sharding.number_slots(sharding.assign_shards(df.limit(0), "k", [1.0]), "shard", ["k", "v"]).count() == 0


# ---- mixing


def slow_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("blocks", [20_000, 5])
def test_mixing_meets_targets(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", blocks)
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", None, "é"])) for i in range(300)]
    rows += [(7, None, "a"), (None, "x y", None), (None, "x y", None), (8, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = mixing.sample_keys(docs)
    got = mixing.mix(keyed, "size", "source", "key", mixing.source_targets(keyed, "source", "size", (3.0, 1.0, 2.0), 1.5, 2.0), ["doc_id", "size"]).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    want = slow_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 20
    # by ascending key, whole epochs first: the taken documents of a source are those with the smallest keys
    for s in sizes:
        mine = sorted((r.key, r.taken // r.size) for r in got if r.source == s and r.size)
        assert [t for _, t in mine] == sorted((t for _, t in mine), reverse=True)


def test_better_documents_are_taken_more(spark):
    rows = [(i, ("a b c d" if i % 2 else "a# b# c# d#"), "s") for i in range(2000)]
    keyed = mixing.sample_keys(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(keyed, "size", "source", "key", mixing.source_targets(keyed, "source", "size", (1.0,), 0.3, 2.0), ["doc_id"]).groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t"))
    t = {r.good: r.t for r in got.collect()}
    assert t[1] > 1.5 * t[0] and abs(t[0] + t[1] - 2400) <= 4


def test_blocks_of_keys_are_even_and_copies_are_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    rng = random.Random(6)
    # most documents of the least quality, and one row that is a third of all
    rows = [(i, "s", 5, -math.log(1 - rng.random()) / (0.05 if i % 5 else 1.0)) for i in range(6000)] + [(-1, "s", 7, 9.0)] * 3000
    blocks = Counter(math.floor(math.log(k) * math.ceil(9000 / 100 / math.e)) for i, _, _, k in rows if i >= 0)
    assert max(blocks.values()) < 150
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, key double").withColumn("target", F.lit("own"))
    got = mixing.mix(df, "size", "source", "key", mixing.source_targets(df, "source", "size", (1.0,), 0.6, 2.0), ["doc_id", "size"])
    assert got.columns == [*df.columns, "source_size", "target_", "taken"]
    got = sorted((r.key, r.doc_id, r.taken) for r in got.collect())
    assert len(got) == 9000
    left, want = 0.6 * sum(r[2] for r in rows), []
    for k, i, size in sorted((r[3], r[0], r[2]) for r in rows):
        want.append((k, i, size if left > 0 and (size <= left or size - left <= left) else 0))
        left -= size
    assert [g[:2] for g in got] == [w[:2] for w in want] and sorted(got) == sorted(want)


# ---- fingerprints


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=3):
    kinds = sorted(set(fps))
    root = {k: k for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                root[find(b)] = find(a)
    return {k: find(k) for k in kinds}


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(1000 + i, t) for i, (_, t) in enumerate(WILD) if t != WILD[5][1]] + [(None, docs[0][1]), (3000, "One TWO"), (3001, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash_dedup.near_duplicates(df).collect()
    fps = {i: slow_simhash(t) for i, t in docs}
    roots = slow_components(fps.values())
    least = {}
    for i, t in docs:
        if i is not None:
            r = roots[slow_simhash(t)]
            least[r] = min(i, least.get(r, i))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{slow_simhash(t):016x}", least[roots[slow_simhash(t)]]) for i, t in docs)
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [4096, 3, 1])
def test_links_of_planted_clusters(spark, dense):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash_dedup.fingerprint_links(df, 3, dense)
    got = {np.uint64(r.node % 2**64).item(): np.uint64(r.root % 2**64).item() for r in simhash_dedup.components(links).collect()}
    want = slow_components(fps)
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps})
    assert groups(got) == groups(want)


def test_popcount_embedding_is_a_lower_bound(spark):
    rng = random.Random(2)
    xs = [rng.getrandbits(64) for _ in range(50)]
    counts = lambda x: [bin((x >> i) & 3).count("1") for i in range(0, 64, 2)]
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in xs], "fp long")
    keys = [r[0] % 2**64 for r in df.select(simhash_dedup.segment_counts(F.col("fp"))).collect()]
    assert [[(k >> i) & 3 for i in range(0, 64, 2)] for k in keys] == [counts(x) for x in xs]
    unary = simhash_dedup.unary_counts(np.array(xs, np.uint64))
    for x, a in zip(xs, unary, strict=True):
        for y, b in zip(xs, unary, strict=True):
            manhattan = sum(abs(p - q) for p, q in zip(counts(x), counts(y), strict=True))
            assert np.bitwise_count(a ^ b) == manhattan <= bin(x ^ y).count("1")


def test_forest_connects_what_is_linked():
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for x in list(fps):
        for _ in range(9):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    got = simhash_dedup.forest(np.array(sorted(fps), np.uint64), 3)
    want = slow_components(fps)
    assert all(bin(int(a) ^ int(b)).count("1") <= 3 for a, b in got)
    assert len(got) == len(fps) - len(set(want.values()))


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000} or got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_document_fingerprints(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(WILD)], "k long, doc_id long, text string")
    got = {r.k: r.fp for r in fingerprint.fingerprints(df, ["k"], "text").collect()}

    def slow(t):
        w = re.split(r"[\x20\x09-\x0D]+", (t or "").lower())
        votes = [0] * 64
        total = 0
        for i, a in enumerate(w):
            h = xxhash.xxh64_intdigest(a.encode(), 42)
            if i + 1 < len(w):
                h = xxhash.xxh64_intdigest(w[i + 1].encode(), h)
            total += len(a)
            for b in range(64):
                votes[b] += len(a) * (h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > total)

    assert {k: v % 2**64 for k, v in got.items()} == {i: slow(t) for i, (_, t) in enumerate(WILD)}


def test_block_tables_find_all_in_radius(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(200)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.q, r.fp) for r in fingerprint.within_radius(df.limit(100), df).collect()}
    few = {r.fp for r in df.limit(100).collect()}
    assert got == {(a, b) for a in few for b in fps if bin(a ^ b).count("1") <= 3}


@pytest.mark.parametrize("size", [3000, 2])
def test_next_documents(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
    rows = [(0, "a"), (3, "b"), (4, "c"), (100, "d"), (101, "e"), (None, "f"), (None, "g"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: r.next_text for r in fingerprint.by_descending_id(df, "doc_id", "text").filter("last = 0").collect()}
    nulls = sorted("fg", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    order = ["", "e", "d", "c", "b", "a", *nulls]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    one = fingerprint.by_descending_id(df.filter("doc_id = 3"), "doc_id", "text").filter("last = 0").collect()
    assert [(r.text, r.next_text) for r in one] == [("b", "b")]
    assert fingerprint.by_descending_id(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("ids", [[*range(5000), 10**15], [-(2**62), 2**62, 2**62 + 5, 2**63 - 1, -(2**63)], [7] * 2000 + [None] * 2000 + [*range(1000)], [9] * 3000, [2**62 + i for i in range(3000)]])
def test_ranges_of_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 100)
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rng", F.lit("clash"))
    got = [r for r in fingerprint.by_descending_id(df, "doc_id", "text").collect() if not r.last]
    assert max(Counter(r.rng for r in got).values()) <= 400
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))]
    assert {r.text: r.next_text for r in got} == dict(zip(order, order[1:] + order[:1], strict=True))


def test_fingerprint_query(spark, monkeypatch):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    check, seen = no_python(monkeypatch, queries)
    df = queries.op10_fingerprints(spark, SF)
    check(df)
    assert len(seen) > 1
    got = {r.doc_id: r for r in df.collect()}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[1][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert got[d].near_next == bits(got[d].fingerprint, got[nxt[0]].fingerprint)
        assert got[d].near_edited == bits(got[d].fingerprint, got[d].edited_fingerprint)
        near = sum(bits(got[d].fingerprint, r.fingerprint) >= 1 - 3 / 64 for r in got.values()) - 1
        assert got[d].n_near == (near if d % 50 == 0 else None)


# ---- language model


def slow_model(texts):
    end, start = object(), object()
    seqs = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), end] for t in texts]
    uni = Counter(w for s in seqs for w in s)
    bi = Counter(p for s in seqs for p in zip([start, *s], s, strict=False))
    ctx = Counter({start: len(seqs)})
    ctx.update({w: c for w, c in uni.items() if w is not end})
    cont = Counter(w for _, w in bi)

    def discount(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
        d = [min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), d, strict=True)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    d2, d1 = discount(bi.values()), discount(cont.values())
    mass = sum(d1(c) for c in cont.values()) / len(bi)
    kept = defaultdict(float)
    for (u, _), c in bi.items():
        kept[u] += d2(c)

    def p(u, w):
        p1 = (cont[w] - d1(cont[w])) / len(bi) + mass / (len(uni) + 1)
        if u not in ctx:
            return p1
        return (bi[u, w] - d2(bi[u, w])) / ctx[u] + kept[u] / ctx[u] * p1

    def score(t):
        s = [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), end]
        n = sum(uni.values())
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in s)
        return len(s), sum(uni[w] > 0 for w in s), base, sum(math.log10(p(u, w)) for u, w in zip([start, *s], s, strict=False))

    vocabulary = [*uni, "never seen"]
    return score, lambda u: sum(p(u, w) for w in vocabulary), start


@pytest.mark.parametrize("bucket", [knlm.BUCKET_TOKENS, 700])
def test_language_model_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(knlm, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(knlm, "CHUNK", 2000 if bucket < 1000 else knlm.CHUNK)
    monkeypatch.setattr(knlm, "MOST_STORED", 2 if bucket < 1000 else knlm.MOST_STORED)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + WILD
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    model = knlm.train(df.filter(~knlm.is_held_out(F.col("doc_id"))))
    assert bool(model.large) == (bucket < 1000)
    score, total, start = slow_model([t for i, t in docs if not held(i)])
    for u in (start, "the", "the,", "unknown to it"):
        assert total(u) == pytest.approx(1.0)
    want = sorted((str(i), *score(t)) for i, t in docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in knlm.with_scores(df, model).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]])


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = knlm.with_scores(df, knlm.train(df.limit(0))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
