"""Every operator on null and repeated ids, null, empty and long texts, ties, an empty table, and further columns whose names clash with its own."""

import pytest
from pyspark.sql import functions as F

from civlake.llm import exact_dedup, language_id, lsh_forest, mixing, packing, quality, repeats, sentence_pieces, spot_signatures, token_counts

LONG = "a long text with many words and a few of them twice " * 3000
ROWS = [(None, "one text"), (None, "one text"), (None, None), (1, "one text"), (1, "another text"), (1, "another text"), (2, ""), (2, None), (3, LONG), (4, LONG + "end"), (5, " \n "), (6, "ΣΙΓΜΑ \U0001f600 é"), (6, "\x00")]
CLASH = "n_bytes n_tokens over_limit size target copies shard p order lang_pred score predicted rejected sig fingerprint near_next keep_id group_size kept text_sha256 n_shingles component_id path tree rep root row carrier spans tid piece_ids round_trip __text decoded positive x part block hot s1 s2 cut id before range head".split()

OPERATORS = {
    "packing": lambda d: packing.pack_tokens(d, 64),
    "token_counts": token_counts.token_counts,
    "mixing": mixing.mix,
    "repeats": repeats.remove_repeats,
    "pieces": lambda d: sentence_pieces.decode(sentence_pieces.encode(d, check="same")),
    "language": lambda d: language_id.identify(d, language_id.train(d)),
    "quality": lambda d: quality.score(d, quality.fit(d, d.filter("doc_id = 1").select("doc_id"))),
    "spots": spot_signatures.edited_and_next,
    "exact": lambda d: exact_dedup.exact_dedup(d, F.col("doc_id") % 2 == 0),
    "near": lsh_forest.near_duplicates,
}


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(k, t, "en" if t and "a" in t else "fr", [None, "s"][n % 2]) for n, (k, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


def rows_of(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.select(columns).collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_clashing_columns(plain, name):
    operate = OPERATORS[name]
    clash = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    want, got = operate(plain), operate(clash)
    shared = [c for c in want.columns if c not in ("pack_id",) and (c in got.columns)]
    expected = rows_of(want, shared)
    assert rows_of(got, shared) == expected
    if name != "packing":
        assert len(expected) == len(ROWS)
    empty = operate(clash.limit(0))
    assert empty.columns == got.columns and empty.collect() == []


def test_what_the_edge_rows_give(plain):
    by = lambda df, *cs: sorted(((r["doc_id"], *(r[c] for c in cs)) for r in df.collect()), key=str)
    exact = exact_dedup.exact_dedup(plain, F.col("doc_id") % 2 == 0)
    groups = {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in exact.collect()}
    assert sorted((str(k), n) for _, k, n in groups) == sorted([("1", 3), ("1", 2), ("2", 3), ("3", 1), ("4", 1), ("5", 1), ("6", 1), ("6", 1)])
    near = by(lsh_forest.near_duplicates(plain), "component_id", "kept")
    assert near.count((None, None, True)) == 3 and near.count((1, 1, True)) == 3 and near.count((4, 3, False)) == 1
    pieces = by(sentence_pieces.encode(plain), "piece_ids")
    assert sum(r[1] == [] for r in pieces) == 3
    cut = by(repeats.remove_repeats(plain), "n_bytes", "n_removed")
    assert (3, len(LONG), len(LONG)) in cut and sum(r[2] == 0 for r in cut) == 11
    taken = mixing.mix(plain).collect()
    assert all(r["copies"] in (0, 1, 2) for r in taken) and {r["size"] for r in taken if r["doc_id"] == 2} == {0}
    spots = spot_signatures.edited_and_next(plain).collect()
    assert all((r["near_next"] is None) == (r["doc_id"] is None) for r in spots)
