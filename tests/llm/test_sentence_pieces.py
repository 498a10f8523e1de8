"""Streaming Viterbi against the library, and proof that it commits early and forgets."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from civlake.llm import sentence_pieces as sp
from civlake.llm.token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return sp.PieceModel(tokenizer_path(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_random_texts_have_the_librarys_ids(model, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices("aabcdeinst ▁\n\t.,é漢字😀0123\x00", k=rng.randint(0, 300))) for _ in range(400)]
    ids, offsets = model.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library.encode(texts)
    back = model.decode_all(pa.array(library.encode(texts), pa.list_(pa.int32()))).to_pylist()
    assert back == [library.decode(x) for x in library.encode(texts)]


def test_a_long_lane_commits_early_and_holds_a_bounded_window(model, library):
    text = "theratingsoftheinternationalstationers" * 3000  # no boundary that no piece crosses
    model.early = model.widest = 0
    assert model.encode(text) == library.encode(text)
    assert model.early > len(text) // 100  # ids were committed long before the end
    assert model.widest < 8 * model.longest  # and what was held did not grow with the text


def test_paths_that_meet_nowhere_are_held_until_they_do(model):
    back = [model.size, -1, -1]
    assert model._meeting(back, 1) == 0
    assert list(model.stream([ord(c) for c in "aaa"])) == list(model._side_by_side(sp.np.array([97] * 3, sp.np.uint32), sp.np.array([3]))[0])


def test_lanes_side_by_side_equal_lanes_in_a_stream(model):
    rng = random.Random(2)
    for _ in range(200):
        codes = [ord(c) for c in rng.choices("▁theraingsot", k=rng.randint(1, 60))]
        wide, _ = model._side_by_side(sp.np.array(codes, sp.np.uint32), sp.np.array([len(codes)]))
        assert list(model.stream(codes)) == wide.tolist()


def test_stretches_of_a_very_long_text(model, library, monkeypatch):
    text = "a stretch of words, and 12 more  words " * 300
    whole = model.encode(text)
    monkeypatch.setattr(sp, "STRETCH", 100)
    assert model.encode(text) == whole == library.encode(text)


def test_null_ids_repeated_rows_and_empty_tables(spark, library):
    rows = [(None, "ab c"), (1, "ab c"), (1, "ab c"), (2, None), (3, ""), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sp.decode(sp.encode(docs, check="same")).collect()
    assert [(r["doc_id"], r["piece_ids"], r["decoded"], r["same"]) for r in got] == [(k, library.encode(t or ""), t or "", True) for k, t in rows]
    assert sp.decode(sp.encode(docs.limit(0))).collect() == []
