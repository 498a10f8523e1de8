"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot is a table of distinct digests with one binary-fuse filter for each range of them.
Incoming digests are grouped among themselves, screened by the filters, and only what passes is
joined with the snapshot's digests and compared byte by byte. A filter never rejects a digest it
holds, so no duplicate is missed; a false positive finds no digest in the exact join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import SPACE, documents, join_hot, stash, text_or_empty

_M = np.uint64(0xBF58476D1CE4E5B9)
FILTER_SCHEMA = "fbucket long, seed long, n_slots long, segment long, slots binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.view(np.uint64) ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    for shift in (30, 27, 31):
        h = (h ^ (h >> np.uint64(shift))) * _M
    return h ^ (h >> np.uint64(29))


def _slots_of(h: np.ndarray, n_slots: int, segment: int) -> np.ndarray:
    """Three slots for each hash, in three consecutive segments."""
    starts = n_slots // segment - 2
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64)
    within = [(h >> np.uint64(k)) & np.uint64(segment - 1) for k in (0, 11, 22)]
    return np.stack([(first + k) * segment + within[k].astype(np.int64) for k in range(3)])


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, slots, segment length, 16-bit fingerprints) of a 3-wise binary-fuse filter over distinct int64 keys.

    Slots that only one key uses are peeled off in rounds; going back through the rounds, each key's
    own slot gets the value that makes the three fingerprints xor to the key's.
    """
    n = len(keys)
    segment = 1 << max(3, min(11, int(np.log2(n + 1) / 1.6) + 2))
    n_slots = (max(1, -(-int(n * 1.25 + 32) // segment)) + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15)
        at = _slots_of(h, n_slots, segment)
        count = np.bincount(at.ravel(), minlength=n_slots)
        owner = np.zeros(n_slots, np.int64)  # xor of the keys' numbers in each slot
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        left, rounds = n, []
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, first = np.unique(owner[single], return_index=True)
            rounds.append((who, single[first]))
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
            left -= len(who)
        if not left:
            slots = np.zeros(n_slots, np.uint16)
            prints = (h & np.uint64(0xFFFF)).astype(np.uint16) ^ (h >> np.uint64(48)).astype(np.uint16)
            for who, own in reversed(rounds):
                a, b, c = slots[at[0, who]], slots[at[1, who]], slots[at[2, who]]
                slots[own] ^= prints[who] ^ a ^ b ^ c
            return seed, n_slots, segment, slots
        if seed % 20 == 0:
            n_slots += (n_slots // segment // 8 + 1) * segment
    raise ValueError("no seed peels: the keys are not distinct")


def in_fuse(keys: np.ndarray, seed: int, n_slots: int, segment: int, slots: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; always true for its own keys."""
    h = _mix(keys, seed * 0x9E3779B97F4A7C15)
    at = _slots_of(h, n_slots, segment)
    prints = (h & np.uint64(0xFFFF)).astype(np.uint16) ^ (h >> np.uint64(48)).astype(np.uint16)
    return (slots[at[0]] ^ slots[at[1]] ^ slots[at[2]]) == prints


def normalised(text):
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, the columns named, sha256 of the normalised text and the 64-bit filter key of each row."""
    sha = F.sha2(F.encode(normalised(text_or_empty()), "UTF-8"), 256)
    return docs.select("doc_id", *others, sha.alias("text_sha256")).withColumn("fkey", F.xxhash64("text_sha256"))


@dataclass
class Snapshot:
    """groups: one row a digest (text_sha256, fkey, keep_id, group_size); filters: one row for each range of digests."""

    groups: DataFrame
    filters: DataFrame
    n_filters: int


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest; partial aggregation keeps a hot digest from gathering in one task."""
    return rows.groupBy("text_sha256", "fkey").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_snapshot(rows: DataFrame, keys_a_filter: int = 100_000) -> Snapshot:
    """The snapshot of a table of digests(). Each filter holds about keys_a_filter digests."""
    groups = stash(grouped(rows), "snapshot")
    n = max(1, -(-groups.count() // keys_a_filter))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, n_slots, segment, slots = build_fuse(np.unique(pdf["fkey"].to_numpy()))
        return pd.DataFrame({"fbucket": [pdf["fbucket"].iloc[0]], "seed": [seed], "n_slots": [n_slots], "segment": [segment], "slots": [slots.tobytes()]})

    keyed = groups.select("fkey", F.pmod("fkey", F.lit(n)).alias("fbucket"))
    return Snapshot(groups, stash(keyed.groupBy("fbucket").applyInPandas(build, FILTER_SCHEMA), "filters"), n)


def screened(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """The rows of groups that pass the snapshot's filters."""
    schema = groups.schema

    def screen(_, new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        new = new[[f for f in schema.names]]
        if filters.empty or new.empty:
            return new.iloc[:0]
        f = filters.iloc[0]
        return new[in_fuse(new["fkey"].to_numpy(), int(f["seed"]), int(f["n_slots"]), int(f["segment"]), np.frombuffer(f["slots"], np.uint16))]

    keyed = groups.withColumn("fbucket", F.pmod("fkey", F.lit(snapshot.n_filters)))
    return keyed.groupBy("fbucket").cogroup(snapshot.filters.groupBy("fbucket")).applyInPandas(screen, schema)


def exact_dedup(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns `others` of every row of docs.

    in_snapshot is a condition on docs: the rows it holds for are the snapshot, the rest are the new
    batch. Null texts count as empty; equal texts share a group whatever side they are on. Rows that
    repeat an id with the same text are all kept or all dropped. A null id is larger than any other. Texts are told apart by their
    sha256; bytes are compared between the two sides' representatives of a digest, not within a side. Very long texts are hashed whole. Copies
    of a text that many rows share are not shuffled to one task.
    An empty table gives an empty result, and further columns of docs are not carried.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others, F.coalesce(in_snapshot, F.lit(False)).alias("in_snapshot"))
    rows = stash(digests(own, "in_snapshot", *others), "digests")
    snapshot = build_snapshot(rows.filter("in_snapshot"))
    new = stash(grouped(rows.filter("not in_snapshot")), "newgroups")
    hits = screened(snapshot, new).select("text_sha256", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    found = stash(hits.join(snapshot.groups, "text_sha256"), "found")
    # the bytes of both representatives of each digest that is on both sides
    wanted = found.select("text_sha256", F.explode(F.array("new_id", "keep_id")).alias("doc_id")).filter("doc_id is not null").distinct()
    texts = own.select("doc_id", normalised(text_or_empty()).alias("t")).join(wanted.hint("merge"), "doc_id").filter(F.sha2(F.encode("t", "UTF-8"), 256) == F.col("text_sha256"))
    equal = texts.groupBy("text_sha256").agg((F.min("t") == F.max("t")).alias("same_bytes"))
    both = found.join(equal, "text_sha256", "left").filter(F.coalesce("same_bytes", F.lit(True)))
    merged = both.select("text_sha256", F.least("keep_id", "new_id").alias("keep_id"), (F.col("group_size") + F.col("new_size")).alias("group_size"))
    alone = snapshot.groups.select("text_sha256", "keep_id", "group_size").unionByName(new.select("text_sha256", "keep_id", "group_size")).join(merged.select("text_sha256"), "text_sha256", "left_anti")
    groups = stash(merged.unionByName(alone), "groups")
    total, largest = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("group_size"), F.lit(0))).first()
    return join_hot(rows, groups, ["text_sha256"], "group_size", total, largest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *others)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; those whose id hashes to an even number stand for the snapshot, the rest for the new batch."""
    return exact_dedup(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
