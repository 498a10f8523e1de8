"""The pipeline stage by stage against plain Python, on a corpus with planted junk, exact and near copies, nulls and repeated ids."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from civlake.llm import quality
from civlake.llm.common import utf8
from civlake.llm.token_counts import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("aeioustrnlmdp", k=rng.randrange(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    rows = [(k, prose(rng.randrange(60, 200)), "en", ["news", "web", None][k % 3], 0) for k in range(140)]
    junk = [(200 + k, "".join(rng.choices("0123456789#$%&@!=+{}|", k=400)), "en", "web", 0) for k in range(40)]
    exact = [(300 + k, rows[k][1].replace(" ", "  \n", 2), "en", "web", 0) for k in range(12)]
    near = [(400 + k, rows[20 + k][1] + " Tail end.", "en", "news", 0) for k in range(12)]
    odd = [(None, rows[30][1], "en", "web", 0), (None, prose(90), "en", "web", 0), (5, prose(80), "en", "news", 0), (41, rows[41][1], "en", "web", 0), (500, None, None, "web", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows + junk + exact + near + odd, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(100)] + [(200 + k, 0, 0) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_stage_against_plain_python(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scorer = quality.trained(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    before = pairs(docs)
    texts = sorted({t or "" for _, t in before})
    scores = dict(zip(texts, scorer.scores(quality.features(*utf8(pa.array(texts, pa.string())))), strict=True))
    good = pairs(stages["quality"](spark, docs, corpus))
    assert good == collections.Counter({p: n for p, n in before.items() if round(scores[p[1] or ""], 9) >= 0.5})
    assert not any(k is not None and 200 <= k < 240 for k, _ in good) and sum(k is not None and k < 140 for k, _ in good) >= 138

    docs = spark.createDataFrame([(k, t, None, ["s", "t"][n % 2], 0) for n, (k, t) in enumerate(sorted(before.elements(), key=str))], SCHEMA)
    least = {}
    for k, t in before:
        least[plain(t)] = min(least.get(plain(t), (True, 0)), (k is None, k or 0))
    once = pairs(stages["exact_dedup"](spark, docs, corpus))
    assert once == collections.Counter({p: n for p, n in before.items() if least[plain(p[1])] == (p[0] is None, p[0] or 0)})

    docs = spark.createDataFrame([(k, t, None, ["s", "t"][n % 2], 0) for n, (k, t) in enumerate(sorted(once.elements(), key=str))], SCHEMA)
    sets = collections.defaultdict(list)
    for k, t in once:
        sets[k].append(shingles(t))
    root = {k: k for k in sets if k is not None}
    for a in root:
        for b in list(root):
            if b < a and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    apart = pairs(stages["near_dedup"](spark, docs, corpus))
    assert apart == collections.Counter({p: n for p, n in once.items() if p[0] is None or root[p[0]] == p[0]})
    assert not any(k is not None and 400 <= k < 412 for k, _ in apart)

    rows = [(k, t, None, ["s", "t", None][n % 3], 0) for n, (k, t) in enumerate(sorted(apart.elements(), key=str))]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    total, weight, target, open_ = 1.5 * sum(sizes.values()), {"s": 5, "t": 2, None: 1}, {}, {"s", "t", None}
    while open_:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} or share
        open_ = open_ - full if full else set()
    out = stages["mixing"](spark, docs, corpus).collect()
    taken = collections.Counter()
    for r in out:
        taken[r["source"]] += size(r["text"])
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 60) for s in target)
    copies = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert all(n <= 2 * apart[p] for p, n in copies.items())

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    ids = {(r["doc_id"], tuple(r["piece_ids"])) for r in stages["sentence_pieces"](spark, docs, corpus).collect()}
    assert ids == {(k, tuple(library.encode(t or ""))) for k, t, *_ in rows}


def test_run_is_its_stages_and_reruns_agree(spark, corpus):
    first = corpus_pipeline.run(spark, corpus).collect()
    rows = lambda rs: collections.Counter((r["doc_id"], r["source"], tuple(r["piece_ids"])) for r in rs)
    assert first and rows(first) == rows(corpus_pipeline.run(spark, corpus).collect())
    ids = {r["doc_id"] for r in first}
    assert not any(k is not None and (200 <= k < 240 or 300 <= k < 312 or 400 <= k < 412) for k in ids) and None in ids
    assert np.mean([k in ids for k in range(140)]) > 0.8


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).collect() == [], name


def test_two_runs_at_once_keep_their_own_tables(spark, tmp_path):
    """Both runs end with the rows of a run alone, and each leaves only its last table."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline
    from civlake.llm import common

    rows = [(k, f"the {k} text of number {k * k} with some words and more {'good' * (k % 3)}", "en", "s" if k % 2 else "t", 9) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = common.shared_dir(spark)
    alone = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    before = set(os.listdir(folder))
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: corpus_pipeline.run(spark, str(tmp_path)), range(2)))
    assert [sorted(map(str, r.collect())) for r in runs] == [alone, alone]
    left = {f.split("-")[0] for f in set(os.listdir(folder)) - before}
    assert left == {"sentence_pieces"} and len(set(os.listdir(folder)) - before) == 2


def test_a_written_table_leaves_no_shuffle_files(spark):
    from civlake.llm import common

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    setting = spark.conf.get(key)
    rows = spark.range(5000, numPartitions=3).selectExpr("id % 7 AS k").groupBy("k").count()
    kept = common.stash(rows, "counts")
    assert not files() - before and spark.conf.get(key) == setting
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_links_take_one_worker_a_task_and_no_broadcast_where_none_is_hot(spark, corpus, monkeypatch):
    from civlake.llm import graph

    plans, write = [], graph.stashed

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "stashed", noted)
    stages = dict(corpus_pipeline.STAGES)
    stages["near_dedup"](spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus)
    # a plan is cut into stages at its exchanges
    assert plans and max(stage.count("MapInArrow") for p in plans for stage in p.split("Exchange")) == 1
    assert not any("Broadcast" in p for p in plans)


def test_hot_keys_apart_from_the_others_or_all_by_a_shuffle(spark, monkeypatch):
    from civlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 100)
    rows = spark.createDataFrame([(0 if n < 300 else n, n) for n in range(400)], "k long, id long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, rows.join(keyed, "k").collect()))
    for largest, broadcast in ((300, True), (100, False)):
        joined = common.join_hot(rows, keyed, ["k"], "n", 400, largest)
        assert sorted(map(tuple, joined.select("k", "id", "n").collect())) == want
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == broadcast
