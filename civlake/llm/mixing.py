"""Mixing sources to target weights by the cube method.

Every document of a source gets the same expected number of copies, target / source size. The whole
part is taken for certain; the fraction is an inclusion probability. The flight phase of the cube
method then moves the probabilities through the null space of two constraints, the number of
documents and the number of words, until at most two are left between 0 and 1. It runs in shards
of bounded size; what a shard leaves over flies again with what other shards of its source left,
level by level, so that one small landing problem a source is all that remains.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlake.llm.common import HOT_KEYS, HOT_ROWS, SPACE, documents, stash

#: Documents that fly together in one shard; with two left from each, a level holds 1/2048 of the one before it.
SHARD_DOCS = 4096
#: Parts in which a source's rows meet its target, so that no source is one task's work.
SALTS = 64
WEIGHTS = (5.0, 2.0, 1.0)
EPS = 1e-9
#: Exchanges after the rounding, at most.
EXCHANGES = 16


def flight(sizes: np.ndarray, p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move probabilities until at most two are fractional, holding their sum and their sum weighted by size.

    Three fractional units at a time: the null vector of [[1, 1, 1], [s1, s2, s3]] is
    (s3 - s2, s1 - s3, s2 - s1). The step is drawn so that expectations hold; the generator
    is seeded by the shard's own rows (their number, words and the seed given), so that reruns agree.
    """
    p, s = p.tolist(), sizes.astype(float).tolist()
    rng = np.random.default_rng([len(s), int(sum(s)) & (1 << 60) - 1, seed & (1 << 63) - 1])
    draws = iter(rng.random(len(s) + 8).tolist())
    held: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0.0 < p[i] < 1.0]
    return np.array(p)


def landing(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the last few probabilities so that words, then documents, come nearest to what is expected.

    Exchanges of a document that is in for one that is out then take back the words that the rounding moved.
    """
    open_ = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    words, docs = float((sizes[open_] * p[open_]).sum()), float(p[open_].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (round(abs(float(np.dot(sizes[open_], x)) - words), 6), abs(sum(x) - docs), x))
    out = np.round(p)
    out[open_] = best
    over = float(np.dot(sizes, out - p))
    for _ in range(EXCHANGES):
        inside, outside = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        moves = []
        if len(inside) and len(outside):
            by_size = outside[np.argsort(sizes[outside], kind="stable")]
            at = np.searchsorted(sizes[by_size], sizes[inside] - over)
            moves += [(abs(over + sizes[j] - sizes[i]), 0, i, j) for k in (0, 1) for i, j in zip(inside, by_size[np.clip(at - k, 0, len(by_size) - 1)], strict=True)]
        # where no exchange helps, one document alone goes in or out
        moves += [(abs(over - sizes[i]), 1, i, -1) for i in inside] + [(abs(over + sizes[j]), 1, -1, j) for j in outside]
        if not moves or (best_move := min(moves))[0] >= abs(over):
            break
        _, _, i, j = best_move
        if i >= 0:
            out[i], over = 0.0, over - sizes[i]
        if j >= 0:
            out[j], over = 1.0, over + sizes[j]
    return out


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    # largest first, so that small documents are left for the landing
    pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    pdf["p"] = flight(pdf["size"].to_numpy(), pdf["p"].to_numpy(), int(np.bitwise_xor.reduce(pdf["order"].to_numpy())))
    if pdf["last"].iloc[0]:
        pdf["p"] = landing(pdf["size"].to_numpy(float), pdf["p"].to_numpy())
    return pdf


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, n_docs, source_size and target, from one row a source.

    Sources in code point order, null last, take the weights in turn and share `share` times all
    words; no target exceeds `most` times its source's words, and the excess is shared anew by
    weight. That ends with the sources sorted by words per weight: the first k stand at their
    limit, where k is the fewest for which the next one's share fits. The windows below see a row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), "turn")
    s = sizes.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("turn", F.lit(len(weights))) + 1))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    weight = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", rest / weight).withColumn("fits", F.col("level") * F.col("w") <= F.col("source_size") * most)
    # the level at which the first fitting source stands holds for all after it
    s = s.withColumn("common", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("source_size") / F.col("w"))).over(Window.partitionBy()))
    full = F.col("source_size") * F.lit(float(most))
    return s.select("source", "n_docs", "source_size", F.least(full, F.coalesce(F.col("common") * F.col("w"), full)).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_docs: int = SHARD_DOCS, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the columns `others` of every row of docs.

    Null texts have size 0; a null source is a source of its own; a source without words has target
    0 and no copies. Rows that repeat an id are separate documents. A null id sorts last. An empty
    table gives an empty result, and further columns of docs are not carried. Of equal rows any may be the one that is taken more often. Rows alike in id and size that are very many
    (more than HOT_ROWS and than one in HOT_KEYS of all) are dealt out to shards by their places in the table, so that no shard holds them all.

    A source whose target is a whole multiple of its words is met exactly. Any other misses its target by less than the largest of the at most `shard_docs`
    documents that take part in its landing, as a rule by far less, since these are small and exchanges follow.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    base = stash(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *others).withColumn("__place", F.monotonically_increasing_id()).withColumn("order", F.xxhash64("doc_id", "size")), "sizes")
    # what decides the shard: an id and a size, and a place for the few pairs of them that very many rows have
    often = base.groupBy("order").agg(F.count(F.lit(1)).alias("alike")).filter(f"alike > {HOT_ROWS}")
    often = stash(often, "alike")
    most_alike = max(HOT_ROWS, base.count() // HOT_KEYS)
    hot = often.filter(F.col("alike") > most_alike).select("order", F.lit(True).alias("__hot"))
    base = base.join(F.broadcast(hot), "order", "left").withColumn("order", F.when(F.col("__hot"), F.xxhash64("order", "__place")).otherwise(F.col("order"))).drop("__hot", "__place")
    per_source = base.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    dim = targets(per_source, share, most, weights).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod("order", F.lit(SALTS)).cast("int")).withColumnRenamed("source", "__source")
    met = salted.join(dim, F.col("__source").eqNullSafe(F.col("source")) & (salted.salt == dim.salt)).drop("__source", "salt")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    met = (
        met.withColumn("rate", F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12), F.when(F.col("source_size") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(rate))
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .withColumn("shards", F.ceil(F.col("n_docs") / shard_docs))
        .withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")))
        .withColumn("last", F.col("shards") == 1)
        .drop("n_docs", "rate")
    )
    done, level = None, met
    while True:
        flown = stash(level.groupBy("source", "shard").applyInPandas(_fly, level.schema), "flight")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done = flown.filter(~open_) if done is None else done.unionByName(flown.filter(~open_))
        if flown.filter(open_).isEmpty():
            break
        fewer = F.ceil(F.col("shards") * 2 / shard_docs)
        level = flown.filter(open_).withColumn("shards", fewer).withColumn("shard", F.pmod("shard", F.col("shards"))).withColumn("last", F.col("shards") == 1)
    return done.select(F.col("doc_id").cast(docs.schema[id_col].dataType), "source", "size", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies"), *others)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes from it."""
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
