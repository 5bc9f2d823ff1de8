from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def library():
    return tokens.load(open(PATH, encoding="utf-8").read())


def counts(texts, table=()):
    return tokens.Lengths(library(), dict(zip(table, tokens.lengths(library(), list(table)), strict=True))).count(texts)


PIECES = st.sampled_from(["Hello", "it's", "'S", "''ll", "x'vey", " ", "\n\t", "\x1c", "\x85", "1234", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "é", "É", "ß", "×", "÷", "ÿ", "µ", "²", "ǅ", "İ", "漢", "é", "😀", "_", "ð"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=4)), max_size=12).map("".join))
def test_equals_the_library(text):
    assert counts([text], ["hello", "it", "'s", "."]) == [len(library().encode(text, add_special_tokens=False).ids)]


def test_caches_begin_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + j)}" for j in range(20)) for k in range(60)]
    assert counts(texts, ["wa"]) == [len(library().encode(t, add_special_tokens=False).ids) for t in texts]


def test_sketch_keeps_frequent_items():
    sketch = tokens.Sketch(8)
    sketch.add([f"r{k}" for k in range(4000)] + ["often"] * 900 + ["also"] * 700)
    other = tokens.Sketch(8)
    batch = sketch.batch()
    other.merge(batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
    assert {k for k, _ in other.counts.most_common(2)} == {"often", "also"}


def test_frames(spark):
    rows = [(1, None), (None, ""), (1, "Hello <|endoftext|> world"), (1, "Hello <|endoftext|> world"), (2, "word " * 30000), (3, "漢字 é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    got = [tuple(r) for r in tokens.token_counts(df, PATH).collect()]
    want = [(i, len((t or "").encode()), n := len(library().encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert got == want
    assert tokens.token_counts(df.limit(0), PATH).collect() == []


def test_sketches_merge_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FAN_IN", 2)
    df = spark.createDataFrame([(f"a b{k}",) for k in range(60)], "text string").repartition(9)
    assert tokens.frequent(df, spark.sparkContext.broadcast(open(PATH, encoding="utf-8").read()))[0] == "a"


def test_one_mark_beyond_latin_leaves_table_and_cache_in_use(spark, monkeypatch):
    texts = ["the cat’s “hat” 漢字 é naïve", "the cat's hat ½ Ünï", "ΣΑΣ ΌΣ", "İstanbul ŉ ǰ", "क्षि e\u0301 \u0301x", "ﬁ Å K"]
    counter = tokens.Lengths(library(), {})
    assert counter.count(texts) == [len(library().encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(tokens, "lengths", lambda tokenizer, words: 1 / 0)
    assert counter.count(texts) == [len(library().encode(t, add_special_tokens=False).ids) for t in texts]
    words = tokens.frequent(spark.createDataFrame([(t,) for t in ["’ the"] * 9], "text string"), spark.sparkContext.broadcast(open(PATH, encoding="utf-8").read()))
    assert "the" in words and any(w.startswith(tokens.MAPPED) for w in words)


def test_cache_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 5000)
    counter = tokens.Lengths(library(), {})
    for text in ["a" * 9000, "b" * 9000 + " c", "a" * 9000]:
        assert counter.count([text]) == [len(library().encode(text, add_special_tokens=False).ids)]
    assert len(counter.cache) <= 2
