"""Rows that are alike in very many copies, and texts with few or no spots."""

import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civlake.llm import mixing, repeats, spot_signatures


def test_rows_of_one_id_and_size_are_dealt_over_shards(spark, monkeypatch):
    n = 60_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")).unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source")))
    largest = spark.sparkContext.accumulator(0)
    groups = spark.sparkContext.accumulator(0)
    fly = mixing._fly

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        groups.add(1)
        largest.add(int(len(pdf) > 2 * mixing.SHARD_DOCS))
        return fly(pdf)

    monkeypatch.setattr(mixing, "_fly", counted)
    taken = mixing.mix(rows)
    words = taken.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(words - 1.5 * (3 * n + 1000)) < 20
    assert groups.value > n // mixing.SHARD_DOCS and largest.value == 0
    assert taken.agg(F.max("copies")).first()[0] == 2


def test_a_text_of_very_many_rows_is_cut_once(spark, monkeypatch):
    sizes = []
    sort = repeats._sorted

    def counted(pieces):
        sizes.append({r["tid"]: r["count"] for r in pieces.groupBy("tid").count().collect()})
        return sort(pieces)

    monkeypatch.setattr(repeats, "_sorted", counted)
    text = "".join(chr(97 + k * k % 26) + str(k) for k in range(200))
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, "start " + text[50:400] + " end"), (9, "short")], "doc_id long, text string"))
    got = repeats.remove_repeats(rows).collect()
    by_id = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got)
    assert by_id == {(7, len(text), len(text), 1): 5000, (8, 360, 350, 1): 1, (9, 5, 0, 0): 1}
    # one carrier's pieces, not those of 5000 rows
    assert max(sizes[0].values()) < 30


@pytest.fixture(scope="module")
def spotless(spark):
    """Texts of 17 words, pairs of which differ in three; one of each pair has a spot."""
    words = "amber birch cedar dune ember fjord grove heath islet jetty knoll ledge marsh north orchard pasture quarry".split()
    plain, spotted = " ".join(words), " ".join([*words[:12], "the", "harbour", "lantern", *words[15:]])
    long = " ".join(f"the {w}{k} {w[::-1]}" for k in range(4) for w in words)
    return spark.createDataFrame([(1, plain), (2, spotted), (3, long), (4, long.replace("amber0", "other")), (5, "Ø Ü"), (6, None)], "doc_id long, text string")


def test_likeness_does_not_fall_to_nothing_where_spots_begin_or_end(spotless):
    sig = {r["doc_id"]: set(r["sig"]) for r in spot_signatures.members(spotless).collect()}
    like = lambda a, b: len(sig[a] & sig[b]) / len(sig[a] | sig[b])
    assert 0.5 < like(1, 2) < 1
    assert like(3, 4) > 0.9 and like(1, 3) < 0.2
    assert len(sig[5]) == 2 and sig[6] == set()
    edited = {r["doc_id"]: r for r in spot_signatures.edited_and_next(spotless).collect()}
    assert edited[2]["near_edited"] > 0.3 and edited[2]["near_next"] > 0.5
