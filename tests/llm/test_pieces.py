import random
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@cache
def both():
    return pieces.Codec(pieces.Vocabulary.read(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(text):
    codec, library = both()
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<i4").tolist() == library.encode(text)
    assert codec.decode(ids) == text.replace(pieces.SPACE, " ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabeinrst  \n\t▁éß漢😀.,-19"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_equals_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "internationalization" * 400, " " * 3000, "漢字" * 500, "=-" * 2000])
def test_long_runs_equal_the_library(text):
    check(text)


def test_streaming_commits_before_the_end():
    codec, _ = both()
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    assert len(list(codec.search(text))) > 10


def test_unigram_paths_have_the_best_score():
    words = {"a": -2.0, "b": -2.5, "ab": -3.9, "abc": -5.0, "c": -3.0, "bc": -4.0, "▁": -2.0, "▁a": -3.0, "ca": -3.1}
    vocabulary = pieces.Vocabulary(["<unk>", *words], [0.0, *words.values()], [pieces.UNKNOWN] + [pieces.NORMAL] * len(words), False, True)
    codec = pieces.Codec(vocabulary)
    rng = random.Random(4)
    for n in (*range(12), 500):
        text = "".join(rng.choice("abc ") for _ in range(n))
        prepared = codec.prepared(text)
        best = [0.0] + [-np.inf] * len(prepared)
        for j in range(1, len(prepared) + 1):
            best[j] = max(best[i] + words.get(prepared[i:j], -np.inf) for i in range(max(0, j - 3), j))
        ids = np.frombuffer(codec.encode(text), "<i4")
        assert sum(vocabulary.scores[k] for k in ids) == pytest.approx(best[-1])
        assert "".join(vocabulary.pieces[k] for k in ids) == prepared


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "Hello  world\n漢", "z"), (2, "a " * 30000, "w")], "doc_id long, text string, id string")
    coded = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert [r["decoded"] for r in coded] == ["", "", "Hello  world\n漢", "a " * 30000] and [len(r["ids"]) for r in coded][:2] == [0, 0]
    assert [tuple(r)[:2] for r in pieces.digests(df, MODEL).collect()][:2] == [(1, 0), (None, 0)]
    assert pieces.encode(df.limit(0), MODEL).collect() == [] and pieces.digests(df.limit(0), MODEL).collect() == []
    over = pieces.encode(df, MODEL, ids_col="id")
    assert over.columns == ["doc_id", "text", "id"] and [len(r["id"]) for r in over.collect()][:2] == [0, 0]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", "y.z")], "doc_id long, text string, ids int, round_trip string, `n.ids` string")
    row = pieces.encode(df, MODEL, checked=True).collect()[0].asDict()
    assert list(row) == ["doc_id", "text", "n.ids", "ids", "decoded_sha256", "round_trip"] and row["round_trip"] is True and len(row["ids"]) == 2
    assert pieces.digests(df, MODEL).collect()[0]["n_ids"] == 2
    assert pieces.decode(df.selectExpr("array(1, 2) ids", "1 decoded"), MODEL).columns == ["ids", "decoded"]


@pytest.mark.parametrize("part", ["the  cat ", "x", "漢字", "  ", "a\nb "])
def test_blocks_of_a_long_text_equal_the_whole(part, monkeypatch):
    codec, library = both()
    text = "".join(f"{part}{k % 97}" for k in range(3000))
    monkeypatch.setattr(pieces, "BLOCK", 500)
    parts = list(codec.blocks(text))
    assert "".join(parts) == codec.prepared(text) and (" " not in text or len(parts) > 5)
    assert np.frombuffer(b"".join(codec.stream(text)), "<i4").tolist() == library.encode(text)
    found = pieces.Returned(codec, text)
    for ids in codec.stream(text):
        found.add(ids)
    assert found.result() == pieces._returned(codec, text, codec.encode(text)) and found.result()[1]
