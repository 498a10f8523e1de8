"""Importance resampling, ranked search and SimHash trees against brute force, on nulls, empty and long texts, ties, repeats, hot rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from civlake.llm import radix, ranked_search, resampling, simhash_tree, words

SCHEMA = "doc_id long, text string"
CLASH = "n_words n_features weight score rank fp fingerprint component_id rows least root reached term terms tfs item item_id n bucket shard digit o".split()
WORDS = "the is le casa Straße naïve 東京 data-set foo's 12,5 x Red BLUE".split()
ITEMS = [(1, "the Red x"), (1, "blue"), (2, None), (3, "casa casa 東京"), (None, "straße data"), (4, "absent zzz"), (5, "")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [" ".join(rng.choice(WORDS) + (str(rng.randrange(4)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    near = [t + " x" for t in made[:20]]
    odd = [None, "", " \n\t", "a", "a  B", "...", "w" * 100 + " " + "v" * 40 + " end", "the Red x " * 3000, "\x00", "é\U0001f600 x"]
    found = [(k * 3, t) for k, t in enumerate(made + near + odd)]
    return found + found[:10] + [(None, "the Red x"), (None, None), (None, "the Red x")] + [(7000, "the same text again and again for all of these rows of one id and twenty words and more so that it may be drawn")] * 40


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def clash(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, targets, percent):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in runs(t)[1])
    s, t = count(x for _, x in rows), count(targets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, text in rows:
        w, f = runs(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10000) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((-r[4], 1 << 63 if r[0] is None else r[0], k) for k, r in enumerate(out) if r[1] >= 20)
    rank = {k: n + 1 for n, (_, _, k) in enumerate(order[: len(order) * percent // 100])}
    return Counter((*r, rank.get(k)) for k, r in enumerate(out))


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_is_the_plain_draw(spark, docs, clash, rows, percent):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain_draw(rows, [t for _, t in ITEMS], percent)
    for table in (docs, clash):
        got = Counter(tuple(r) for r in resampling.resample(table, items, percent).collect())
        assert got == want


def test_resampling_without_documents_target_or_long_texts(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert resampling.resample(docs.limit(0), items).collect() == []
    got = Counter(tuple(r) for r in resampling.resample(docs, items.limit(0)).collect())
    assert got == plain_draw(rows, [], 5)
    short = docs.filter("length(text) < 20")
    assert {r["rank"] for r in resampling.resample(short, items).collect()} == {None}


def test_features_cross_blocks_and_not_texts(monkeypatch):
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 3)
    texts = ["One two three four five", "", "six", "seven eight " + "n" * 90, "é 東京 x1 y2 z3 a4"]
    raw = [t.encode() for t in texts]
    found = [[] for _ in texts]
    for of, crc in resampling.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])):
        for k, c in zip(of, crc, strict=True):
            found[k].append(int(c))
    assert [sorted(f) for f in found] == [sorted(zlib.crc32(x.encode()) for x in runs(t)[1]) for t in texts]


def test_the_kth_key_and_ranks_without_a_sort_of_the_table(spark):
    rng = random.Random(3)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(rng.choice([low, high, 0, -5, 7, rng.randrange(low, high), rng.randrange(-90, 90)]), rng.choice([1, 2, high, rng.randrange(70000)]), k) for k in range(700)]
    df, keys = spark.createDataFrame(rows, "a long, b long, c long").repartition(4), ["a", "b", "c"]
    want = sorted(rows)
    for k in (1, 2, 350, 699, 700):
        assert radix.kth_key(df, keys, k) == want[k - 1]
        assert df.filter(radix.up_to(keys, want[k - 1])).count() == k
    assert radix.kth_key(df, keys, 701) is None
    assert [tuple(r) for r in radix.ranked(df, keys).orderBy("rank").collect()] == [(*r, k + 1) for k, r in enumerate(want)]


def plain_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in found:
            s = 0
            for t, m in wanted.items():
                if c[t]:
                    df = sum(1 for _, d in found if d[t])
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df + 1)))
                    s += m * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + (75 * c.total() * n_docs) // n_terms)))
            if s > 0:
                scores.append((-s, 1 << 63 if i is None else i))
        out += [(item, r + 1, None if i == 1 << 63 else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 10, 500])
def test_search_is_the_plain_ranking(spark, docs, clash, rows, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("own"))
    want = plain_search(rows, ITEMS, k)
    for table in (docs, clash):
        assert sorted((tuple(r) for r in ranked_search.search(table, items, k).collect()), key=str) == want
    assert {r[0] for r in want} == {1, 3, None}


def test_search_in_many_ranges_levels_and_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 8)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in ranked_search.search(docs, items).collect()), key=str) == plain_search(rows, ITEMS)
    assert ranked_search.search(docs.limit(0), items).collect() == [] and ranked_search.search(docs, items.limit(0)).collect() == []


def test_a_tree_opens_nodes_of_equal_bounds_and_few_others(monkeypatch):
    rng = np.random.default_rng(2)
    n, vocabulary = 5000, 12
    counts = rng.integers(0, 6, n)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    terms = np.concatenate([rng.choice(vocabulary, c, replace=False) for c in counts]).astype(np.int64)
    share = rng.integers(1, 9, len(terms)) * (1 + 40 * (np.repeat(np.arange(n), counts) == 4321))
    tree = ranked_search.Tree(bounds, terms, share, vocabulary)
    weights = np.zeros(vocabulary, np.int64)
    weights[[1, 5, 7]] = [3, 3, 2]
    scores = [int((weights[terms[a:b]] * share[a:b]).sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    opened = []
    sums = ranked_search.Tree.sums
    monkeypatch.setattr(ranked_search.Tree, "sums", lambda *a: opened.append(a[3] - a[2]) or sums(*a))
    for k in (1, 10, 4000):
        best = []
        opened.clear()
        tree.best(weights, list(range(n)), k, best)
        want = sorted(((s, -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:k]
        assert sorted(best, reverse=True) == want
        if k == 1:
            assert sum(opened) < n / 2


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(points, bits):
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, p in enumerate(points):
        for q in points[:k]:
            if (p ^ q).bit_count() <= bits:
                a, b = root(p), root(q)
                up[max(a, b)] = min(a, b)
    return {p: root(p) for p in points}


@pytest.mark.parametrize("shard", [8, 4096])
def test_simhash_components_are_the_plain_ones(docs, clash, rows, shard):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = linked(sorted(set(prints)), 2)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        least[root[p]] = min((x for x in (least.get(root[p]), i) if x is not None), default=None)
    want = Counter((i, f"{p:016x}", least[root[p]]) for (i, _), p in zip(rows, prints, strict=True))
    assert len(set(least)) < len(set(prints)) < len(rows)
    for table in (docs, clash):
        assert Counter(tuple(r) for r in simhash_tree.near_fingerprints(table, shard=shard).collect()) == want
    assert simhash_tree.near_fingerprints(docs.limit(0)).collect() == []


def planted():
    """Random points, a dense ball, points that share all but 12 bits, and points two and three bits from others."""
    rng = np.random.default_rng(9)
    alone = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    bit = lambda k: np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)
    ball = alone[0] ^ bit(800) ^ bit(800)
    low = alone[1] ^ rng.integers(0, 1 << 12, 600, dtype=np.uint64)
    return np.unique(np.concatenate([alone, ball, low, alone[:500] ^ bit(500) ^ bit(500), alone[500:900] ^ bit(400) ^ bit(400) ^ bit(400)]))


def test_every_near_pair_is_found_and_no_other():
    points = planted()
    want = set()
    for k in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[k + 1 :] ^ points[k]) <= 2) + k + 1:
            want.add((int(points[k]), int(points[j])))
    got = set()
    for a, b in simhash_tree.near_pairs(points, 2):
        got |= {tuple(sorted((x % (1 << 64), y % (1 << 64)))) for x, y in zip(a, b, strict=True)}
    assert got == want and len(want) > 5000


def test_shards_are_balanced_and_hold_every_near_pair():
    points = planted()
    rng = np.random.default_rng(1)
    tree = simhash_tree.Tree(rng.permutation(points)[:1200], 24, 2)
    shards = dict(tree.placed(points))
    assert 12 <= len(shards) and max(map(len, shards.values())) < len(points) / 4
    where = {}
    for leaf, found in shards.items():
        for p in found.tolist():
            where.setdefault(p, set()).add(leaf)
    assert len(where) == len(points)
    for a, b in simhash_tree.near_pairs(points, 2):
        assert all(where[x % (1 << 64)] & where[y % (1 << 64)] for x, y in zip(a, b, strict=True))


def test_long_texts_in_stretches_are_as_whole_ones(monkeypatch):
    text = " ".join(random.Random(4).choice(WORDS) for _ in range(3000))
    whole = (simhash_tree.fingerprint(text), ranked_search.terms_of(text))
    assert whole[0] == plain_fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(words.stretches, "__defaults__", (size,))
        assert (simhash_tree.fingerprint(text), ranked_search.terms_of(text)) == whole
        assert b"".join(words.stretches(text.encode(), words.byte_class("0-9a-z"))) == text.encode()
    assert simhash_tree.fingerprint(None) == simhash_tree.fingerprint(" \n") == 0
