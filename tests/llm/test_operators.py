"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from civlake.llm import chunks, exact_dedup, graph, language_id, lsh_forest, mixing, packing, quality, repeats, sentence_pieces, spot_signatures, token_counts
from civlake.llm.common import documents
from civlake.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the is le der casa Straße naïve 東京 data-set foo's 12,5 x y z red blue".split()


def made(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [made(rng, rng.randrange(1, 120)) for _ in range(30)]
    near = [b.replace(" ", "  ", 1) if k % 2 else b.rsplit(" ", 1)[0] for k, b in enumerate(base)]
    long = made(rng, 4000)
    odd = [None, "", None, " \n\t", "a", "a b", "A  B", "...", " ", "aaaa" * 200, long, long + " end", "<|endoftext|> and <|endoftext|>", "é\U0001f600 \x00 end\r\n\r\n  two"]
    return base + base[:5] + near + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", None, "s1"][k % 4], 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_are_the_librarys(docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs))
    for k, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), want, want > 512)
    assert token_counts.token_counts(empty).count() == 0


def test_packing_loses_nothing(docs, texts, empty):
    import base64

    import tiktoken

    with open(token_counts.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=chunks.PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})
    packed = packing.pack_tokens(docs, 64)
    own = collections.defaultdict(dict)
    for r in packed.collect():
        ids = np.frombuffer(r["input_ids"], "<i4")
        assert len(ids) == r["n_tokens"] <= 64 and r["cu_seqlens"][-1] == len(ids) and r["reset_at"] == r["cu_seqlens"][:-1]
        for a, b, d, s in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["segment_doc"], r["segment_start"], strict=False):
            own[d][s] = ids[a:b].tolist()
    for k, t in enumerate(texts):
        assert [x for s in sorted(own[k]) for x in own[k][s]] == [*enc.encode_ordinary(t or ""), 50256]
    matrices = packing.id_matrices(packed, 8, 64).collect()
    rows = packed.orderBy("pack_id").collect()
    at = 0
    for m in sorted(matrices, key=lambda m: m["matrix_id"]):
        ids, places = (np.frombuffer(m[c], "<i4").reshape(m["n_rows"], 64) for c in ("ids", "positions"))
        for k, r in enumerate(rows[at : at + m["n_rows"]]):
            assert ids[k].tobytes() == bytes(r["input_ids"]) + bytes(4 * (64 - r["n_tokens"]))
            assert [c for c in ("n_tokens", "cu_seqlens", "reset_at", "segment_doc", "segment_start") if m[c][k] != r[c]] == []
            assert places[k].tolist() == [i - max(s for s in r["reset_at"] if s <= i) for i in range(r["n_tokens"])] + [0] * (64 - r["n_tokens"])
        at += m["n_rows"]
    assert sum(m["n_rows"] for m in matrices) == packed.count()
    assert packing.pack_tokens(empty).count() == 0
    once = packing.packed_matrices(docs, 64, rows_a_matrix=8, positions=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, matrices))
    assert packing.packed_matrices(empty).count() == 0


def test_best_fit_decreasing_fills_the_tightest_row():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths, open_ = rng.integers(1, 40, 60), []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, room in enumerate(open_) if room >= n]
            if fits:
                open_[min(fits, key=lambda k: open_[k])] -= n
            else:
                open_.append(40 - n)
        rows = packing.best_fit_decreasing(lengths, 40)
        assert sorted(40 - sum(lengths[k] for k in r) for r in rows) == sorted(open_)
        assert sorted(k for r in rows for k in r) == list(range(60))


def test_sentence_pieces_are_the_librarys(docs, texts, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    got = by_id(sentence_pieces.decode(sentence_pieces.encode(docs.withColumn("piece_ids", F.lit("clash")))))
    for k, t in enumerate(texts):
        assert got[k]["piece_ids"] == library.encode(t or "")
        assert got[k]["decoded"] == library.decode(library.encode(t or ""))
    assert sentence_pieces.encode(empty).count() == 0


def test_mix_keeps_to_targets(docs, texts, empty, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(re.findall(rb"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] or "").encode())) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
    total = 1.5 * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), total
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 60)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    assert mixing.mix(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "x", "en", "b", 0)], SCHEMA)
    assert sorted(r["copies"] for r in mixing.mix(wordless).collect())[:2] == [0, 0]


def test_flight_holds_both_sums():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    out = mixing.flight(sizes, p)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * sizes).sum() == pytest.approx((p * sizes).sum())


def brute_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k : k + n] for r in raws for k in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - n + 1):
            if seen[r[k : k + n]] > 1:
                gone[k : k + n] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [50, 200])
def test_repeats_against_brute_force(docs, texts, empty, length):
    got = by_id(repeats.remove_repeats(docs.withColumn("n_bytes", F.lit("clash")), length, with_text=True))
    for k, want in enumerate(brute_repeats(texts, length)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, k
        assert hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == want[3]
    assert repeats.remove_repeats(empty).count() == 0


def test_triggers_of_long_texts_are_the_same():
    data = np.random.default_rng(4).integers(97, 101, 5000).astype(np.uint8)
    h = repeats.Hashes(data)
    assert (repeats._triggers(h, len(data), 200) == repeats._long_triggers(h, len(data), 200)).all()


def test_language_id_on_held_out_rows(spark, docs, empty):
    rows = documents(spark, SMALL).filter("lang is not null and text is not null")
    truth = {r["doc_id"]: r["lang"] for r in rows.select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op6_language_id"](spark, SMALL).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.85
    dictionaries = language_id.train(docs)
    odd = by_id(language_id.identify(docs, dictionaries))
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k, r in odd.items() if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_language_id_with_languages_of_little_or_no_text(spark):
    rows = documents(spark, SMALL).filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "kolme pient\u00e4 kissaa", "fi"), (-2, "123 456 789", "zz"), (-3, "000 --- 11", "zz")], "doc_id long, text string, lang string")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    dictionaries = language_id.train(rows.filter(~held_out).unionByName(odd))
    assert "zz" not in dictionaries and dictionaries["fi"] == "kolme pient\u00e4 kissaa".encode()
    assert min(len(d) for lang, d in dictionaries.items() if lang != "fi") > 1000
    got = language_id.identify(rows.filter(held_out), dictionaries).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.85
    assert language_id.train(odd.filter("lang = 'zz'")) == {}


def test_a_large_dictionary_does_not_win_by_its_size():
    rng = random.Random(3)
    kinds = {lang: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)] for lang in "ab"}
    text = lambda lang, n: " ".join(rng.choice(kinds[lang]) for _ in range(n))
    held = (("a", text("a", 9000).encode()), ("b", text("b", 60).encode()))
    for lang in "ab":
        assert np.mean([language_id.classify(text(lang, 40), held)[0] == lang for _ in range(50)]) > 0.95


def test_quality_ranks_held_out_rows(spark, docs, empty):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in got if labels[r["doc_id"]] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8
    scorer = quality.fit(docs, docs.filter("doc_id < 0").select("doc_id"))
    assert {r["score"] for r in quality.score(docs, scorer).collect()} == {0.5}
    assert quality.score(empty, scorer).count() == 0


def test_spot_fingerprints_of_edited_texts(docs, texts, empty, spark):
    got = by_id(spot_signatures.edited_and_next(docs))
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[k - 1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    same = collections.defaultdict(set)
    for k, t in enumerate(texts):
        same[t or ""].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert spot_signatures.edited_and_next(empty).count() == 0
    repeated = spark.createDataFrame([(1, "is one two", None, None, 0), (1, "is three four", None, None, 0), (None, "is five six", None, None, 0)], SCHEMA)
    assert spot_signatures.edited_and_next(repeated).count() == 3


def test_predecessors_over_many_ranges(spark):
    ids = sorted(random.Random(3).sample(range(-(10**12), 10**12), 900)) + list(range(2 * 10**12, 2 * 10**12 + 900))
    got = dict(spot_signatures._predecessors(spark.createDataFrame([(i,) for i in ids], "id long"), 16).collect())
    assert got == dict(zip(ids, [None, *ids[:-1]], strict=True))


def test_spot_near_duplicates(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["the", "is", "le", f"w{rng.randrange(500)}", f"w{rng.randrange(500)}"]) for _ in range(150)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base + [b + " tail end" for b in base] + [b.rsplit(" ", n)[0] for b in base for n in (8, 15, 25, 40)])] + [(None, base[0]), (3, base[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reps = {}
    for r in spot_signatures.members(df).filter("doc_id is not null").collect():
        reps[frozenset(r["sig"])] = min(r["doc_id"], reps.get(frozenset(r["sig"]), r["doc_id"]))
    want = {tuple(sorted((reps[a], reps[b]))) for a in reps for b in reps if a != b and len(a & b) >= 0.8 * len(a | b)}
    assert len(want) > 60
    assert {(r["rep_a"], r["rep_b"]) for r in spot_signatures.near_duplicates(df).collect()} == want
    monkeypatch.setattr(spot_signatures, "CELL_ROWS", 3)
    assert {(r["rep_a"], r["rep_b"]) for r in spot_signatures.near_duplicates(df).collect()} == want
    assert spot_signatures.near_duplicates(df.limit(0)).count() == 0


def test_exact_dedup(docs, texts, empty):
    got = by_id(exact_dedup.exact_dedup(docs, F.col("doc_id") % 2 == 0))
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(k)
    for t, ks in groups.items():
        for k in ks:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (ks[0], len(ks), k == ks[0], hashlib.sha256(t.encode()).hexdigest())
    for side in (F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        assert sum(r["kept"] for r in exact_dedup.exact_dedup(docs, side).collect()) == len(groups)
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def test_fuse_filter_never_misses():
    rng = np.random.default_rng(9)
    for n in (1, 2, 10, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**63), 2**63, n))
        made_ = exact_dedup.build_fuse(keys)
        assert exact_dedup.in_fuse(keys, *made_).all()
        other = rng.integers(-(2**63), 2**63, 20_000)
        assert exact_dedup.in_fuse(other, *made_).mean() < 0.001


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return sets, root


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, texts, empty, k, percent):
    sets, root = brute_components(texts, k, percent)
    got = by_id(lsh_forest.near_duplicates(docs, k, percent))
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i), i
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_near_duplicates_in_families_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_SETS", 24)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 2, 3, 9, 20])):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    _, root = brute_components(texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(lsh_forest.near_duplicates(df, 3, 85))
    assert [got[i]["component_id"] for i in range(len(texts))] == root


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_in_large_families_miss_no_link(spark, monkeypatch, percent):
    rng = random.Random(percent)
    # chains whose neighbours are barely alike, all through one text, so that candidates tie them to one family
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(12):
        words = list(base)
        for _ in range(6):
            texts.append(" ".join(words))
            for at in rng.sample(range(0, 195, 5), 5 if percent == 85 else 7):
                words[at] = f"w{rng.randrange(10**6)}"
    giant = " ".join(f"g{rng.randrange(10**6)}" for _ in range(3000))
    texts += [giant, giant.replace(" g1", " h1"), giant.rsplit(" ", 300)[0]]
    _, root = brute_components(texts, 3, percent)
    rows = [*enumerate(texts), (40, texts[40]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, most in {"BLOCK_SETS": 2, "BLOCK_SHINGLES": 1000}.items():
        monkeypatch.setattr(lsh_forest, name, most)
    for name, most in {"KEY_ROWS": 3, "PIECE_SHINGLES": 100}.items():
        monkeypatch.setattr(lsh_forest, name, most, raising=False)
    got = by_id(lsh_forest.near_duplicates(df, 3, percent))
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 3), (5, 5)]
    forest = graph.Forest()
    for a, b in pairs:
        if a is not None and a != b:
            forest.link(a, b)
    got = dict(graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect())
    assert got == {x: forest.root(x) for x in forest.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
    docs = documents(spark, SMALL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        assert docs.columns == before.columns, name


def test_pipeline_stages_on_rows_without_ids_and_of_one_id(spark):
    import corpus_pipeline

    exact = spark.createDataFrame([(5, "a", None, "s", 1), (7, "a", None, "s", 1), (7, "b", None, "s", 1), (None, "a", None, "s", 1), (None, "c", None, None, 1), (9, None, None, "s", 1)], SCHEMA)
    rows = lambda df: sorted((tuple(r)[:2] for r in df.collect()), key=str)
    assert rows(corpus_pipeline.exact_copies_out(spark, exact, SMALL)) == sorted([(5, "a"), (7, "b"), (None, "c"), (9, None)], key=str)

    base = [f"w{k}" for k in range(60)]
    near, far = " ".join([*base[:-1], "x"]), " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(5, " ".join(base), None, "s", 1), (8, near, None, "s", 1), (None, near, None, "s", 1), (None, None, None, "s", 1), (9, far, None, "s", 1), (9, far, None, "s", 1)], SCHEMA)
    assert rows(corpus_pipeline.near_copies_out(spark, docs, SMALL)) == sorted([(5, " ".join(base)), (None, near), (None, None), (9, far), (9, far)], key=str)

    # words of one source are taken 1.5 times; four rows of one id, four of none
    many = spark.createDataFrame([(3, f"p{k} q r s", None, "s", 1) for k in range(4)] + [(None, f"n{k} q r s", None, "s", 1) for k in range(4)], SCHEMA)
    got = collections.Counter(r["text"] for r in corpus_pipeline.mixed(spark, many, SMALL).collect())
    assert sum(got.values()) == 12 and set(got.values()) == {1, 2} and len(got) == 8


def brute_signature(text):
    """The spots of a text, word by word: an anchor, then a chain of words that are not common, up to three common ones before each; and the words with the smallest hashes."""
    words = re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    words = [w for w in words if w]
    common, spots = set(spot_signatures.COMMON), set()
    for i, w in enumerate(words):
        if w in spot_signatures.ANCHORS:
            at, chain = i + 1, [w]
            for _ in range(spot_signatures.CHAIN):
                start = at
                while at < len(words) and words[at] in common and at - start < 3:
                    at += 1
                if at >= len(words) or words[at] in common:
                    break
                chain += words[start : at + 1]
                at += 1
            else:
                spots.add(" ".join(chain))
    signed = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64)
    return {("spot", s) for s in spots} | {("word", w) for w in sorted(set(words), key=signed)[: spot_signatures.LEAST_WORDS]}


def test_signatures_and_likeness_against_brute_force(spark, docs, texts):
    rng = random.Random(12)
    pool = "the is was to of and a in der und la el red blue green car Haus maison 12 x-ray".split()
    made_texts = [" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(60)] + texts
    df = spark.createDataFrame(list(enumerate(made_texts)), "doc_id long, text string")
    got = by_id(spot_signatures.edited_and_next(df))
    names = {}
    sizes = {r["doc_id"]: r["n"] for r in spot_signatures.members(df).select("doc_id", F.size("sig").alias("n")).collect()}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, t in enumerate(made_texts):
        t, nxt = t or "", made_texts[k - 1] or ""
        cut = len(t) // 3
        own, edited, other = (brute_signature(x) for x in (t, t[: len(t) - cut] + nxt[:cut], nxt))
        assert sizes[k] == len(own), k
        assert names.setdefault(frozenset(own), got[k]["fingerprint"]) == got[k]["fingerprint"]
        assert got[k]["near_edited"] == pytest.approx(like(own, edited)), k
        assert got[k]["near_next"] == pytest.approx(like(own, other)), k


def test_predecessors_with_an_id_far_away(spark):
    ids = [*range(5000), 4 * 10**18]
    df = spot_signatures._predecessors(spark.range(5000).select(F.col("id")).unionByName(spark.createDataFrame([(4 * 10**18,)], "id long")), 100)
    assert dict(df.collect()) == dict(zip(ids, [None, *ids[:-1]], strict=True))


def test_language_id_equals_plain_compression(spark):
    import zstandard

    held = (("b", b"the cat sat on the mat and the dog " * 20), ("a", b"der hund und die katze sitzen auf " * 20))
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join(rng.choices("the cat dog sat hund katze und die 12 ! naive".split(), k=rng.randrange(1, 900)))
        own = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        sizes = []
        for _, d in held:
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(own[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(own), language_id.BLOCK_BYTES)))
        got = language_id.classify(text, held)
        if sizes[0] + sizes[1]:
            assert got[0] == held[sizes[1] < sizes[0]][0] and got[1] == pytest.approx(1 - min(sizes) / max(sizes))


def test_language_id_of_texts_without_letters_null_ids_and_clashes(spark):
    rows = [(None, "\u00b2 \u00bd 3 \u2460 \u2163"), (1, "123 --"), (1, None), (2, ""), (None, "wort und wort"), (2, "\u0301")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    got = language_id.identify(df, {"de": b"wort und satz", "en": b"word and phrase"}).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(k, "de" if t and "wort" in t else "und") for k, t in rows]
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    many = spark.createDataFrame([(None, f"{x} {x}{x}", x) for x in "abcdef"] + [(None, "f f", "f")], "doc_id long, text string, lang string")
    assert list(language_id.train(many, languages=2)) == ["f", "a"]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_quality_with_few_positives(spark, docs, n):
    trusted = spark.createDataFrame([(k,) for k in range(n)] + [(None,)] * 2, "doc_id long")
    scorer = quality.fit(docs, trusted)
    rows = quality.score(docs.withColumn("score", F.lit("clash")), scorer).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len({(r["text"] or "", r["score"]) for r in rows}) == len({r["text"] or "" for r in rows})


def test_quality_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_fit", lambda x, positive, prior, seed=7: seen.append(len(x)) or [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.zeros(1)])
    many = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("a text "), F.col("id").cast("string")).alias("text"))
    quality.fit(many, spark.createDataFrame([(0,)], "doc_id long"), positives=5, unlabelled=5)
    assert max(seen) == 3


def test_quality_risk_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    x, positive, prior = rng.normal(0, 1, (40, 5)), np.arange(40) < 12, 0.4
    w = [rng.normal(0, 1, (5, quality.HIDDEN)), rng.normal(0, 1, quality.HIDDEN), rng.normal(0, 1, quality.HIDDEN), rng.normal(0, 1, 1)]

    def risk(w):
        z = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        as_positive, as_negative = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
        return prior * as_positive[positive].mean() + as_negative[~positive].mean() - prior * as_negative[positive].mean()

    value, grads = quality.risk_and_gradient(w, x, positive, prior)
    assert value == pytest.approx(risk(w))
    for k, part in enumerate(w):
        for at in list(np.ndindex(part.shape))[:6]:
            more, less = [p.copy() for p in w], [p.copy() for p in w]
            more[k][at] += 1e-6
            less[k][at] -= 1e-6
            assert grads[k][at] == pytest.approx((risk(more) - risk(less)) / 2e-6, abs=1e-5)


def test_join_hot_equals_a_plain_join(spark, monkeypatch):
    from civlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    want = sorted(map(tuple, rows.join(keyed, "k").select("k", "id", "n", "most").collect()))
    assert sorted(map(tuple, common.join_hot(rows, keyed, ["k"], "n", 500).select("k", "id", "n", "most").collect())) == want


def test_repeats_with_very_many_copies_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_ROWS", 20)
    rng = random.Random(4)
    hot, part = ("".join(rng.choices("abcdefg ", k=500)) for _ in range(2))
    texts = [hot] * 60 + ["short"] * 60 + [hot[100:350] + part, part[:300], part[50:260], None, "", "x" * 600]
    df = spark.createDataFrame([(k % 70, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted(tuple(r)[1:] for r in repeats.remove_repeats(df).collect())
    assert got == sorted(brute_repeats(texts, 200))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.select(", ".join(df.columns)).fetchall()))
