import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import language


def corpora(seed=1, n=120):
    rng = random.Random(seed)
    sounds = {"aa": ["la", "ou", "que", "é"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["the", "ing", "tion", "on"]}
    text = lambda s, k: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(k))
    return [(lang, text(s, rng.choice([2, 20, 60]))) for _ in range(n) for lang, s in sounds.items()]


def reference(counts, order, alphabet):
    """-log2 p(c | h) of an interpolated Kneser-Ney model, computed from its definition."""
    grams = [Counter() for _ in range(order + 1)]
    for word, k in counts.items():
        s = "\x01" + word + "\x02"
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    grams[n][s[i - n + 1 : i + 1]] += k
    used = [None] * (order + 1)
    for n in range(1, order + 1):
        kinds = Counter(g[1:] for g in grams[n + 1]) if n < order else None
        used[n] = {g: (k if n == order or g[0] == "\x01" else kinds.get(g, 1)) for g, k in grams[n].items()}

    def p(h, c):
        n = len(h) + 1
        if n == 0:
            return 1 / (alphabet + 1)
        lower = p(h[1:], c) if h else 1 / (alphabet + 1)
        own = {g: k for g, k in used[n].items() if g[:-1] == h}
        if not own:
            return lower
        one, two = (sum(v == x for v in used[n].values()) for x in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        total = sum(own.values())
        return max(own.get(h + c, 0) - d, 0) / total * ((h + c) in own) + d * len(own) / total * lower

    return lambda h, c: -math.log2(p(h, c))


def test_costs_are_kneser_ney():
    counts = {"x": {"aba": 3, "abc": 1, "cab": 2, "b": 1, "bab": 1}, "y": {"zzz": 2, "aby": 1, "y": 2}}
    model = language.fit(counts)
    alphabet = len({c for t in counts.values() for w in t for c in w}) + 1
    for k, lang in enumerate(model.langs):
        cost = reference(counts[lang], language.ORDER, alphabet)
        for word in ("aba", "abab", "b", "zab", "q", "aqb"):
            s = "\x01" + word + "\x02"
            want = sum(cost(s[max(0, i - language.ORDER + 1) : i], s[i]) for i in range(1, len(s)))
            assert model.word_costs([word])[0, k] == pytest.approx(want)


def test_held_out_accuracy(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(corpora())]
    model = language.train(spark.createDataFrame(rows[:240], "doc_id long, text string, lang string"))
    test = spark.createDataFrame(rows[240:], "doc_id long, text string, lang string")
    got = {r["id"]: r for r in language.predict(test, model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows[240:]) >= 0.98 * 120
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in got.values())


def test_edges(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(corpora())]
    model = language.train(spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))
    odd = [(1, None), (None, ""), (2, "123 ... ²½"), (3, "Ωμέγα " * 2000), (4, "LAOU ouque"), (4, "LAOU ouque"), (5, "schung " * 40000)]
    df = spark.createDataFrame([(*r, 7, "z") for r in odd], "doc_id long, text string, id int, score string")
    got = [(r["id"], r["lang_pred"], r["rejected"]) for r in language.predict(df, model).collect()]
    assert [g[0] for g in got] == [r[0] for r in odd]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and got[3][2] and got[4][1:] == ("aa", False) == got[5][1:] and got[6][1:] == ("bb", False)
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5]
    assert language.predict(df.limit(0), model).collect() == []


def test_scorer_cache_begins_anew(monkeypatch):
    model = language.fit({lang: Counter(w for g, t in corpora() if g == lang for w in t.split()) for lang in ("aa", "bb", "cc")})
    texts = [t for _, t in corpora(2, 20)]
    want = language.Scorer(model).entropies(texts)
    monkeypatch.setattr(language, "CACHE", 100)
    got = language.Scorer(model).entropies(texts)
    assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_every_labelled_language_is_learned(spark, n):
    small = {f"l{k:02d}": chr(0x3B1 + k) + chr(0x3B2 + k) for k in range(16)}
    rows = [(lang, " ".join([w * 2, w * 3, w] * 20)) for lang, w in small.items() for _ in range(n)]
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate([*rows, *corpora(n=20)])], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.langs == sorted({*small, "aa", "bb", "cc"})
    got = language.predict(df, model).collect()
    assert [r["lang_pred"] for r in got[: len(rows)]] == [lang for lang, _ in rows] and not any(r["rejected"] for r in got[: len(rows)])


def test_a_single_labelled_document_is_enough(spark):
    for k in range(12):
        model = language.train(spark.createDataFrame([(k, "la ou que", "aa")], "doc_id long, text string, lang string"))
        assert model.langs == ["aa"]


def test_languages_on_both_sides_of_the_bound(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(corpora(n=400)) if lang != "cc" or k < 30]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=150, calibration_docs=50)
    test = corpora(5, 40)
    got = language.predict(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(test)], "doc_id long, text string"), model).collect()
    assert sum(r["lang_pred"] == lang for r, (lang, _) in zip(got, test, strict=True)) >= 0.95 * len(test)
    assert np.isfinite(model.ceilings).all() and not any(r["rejected"] for r in got)


def test_numerals_part_words_and_drop_no_letter():
    assert language.words_of("km² CO₂ x²y ½a ² 12") == ["km", "co", "x", "y", "a"]
    assert language.words_of("²½ 1") == [] == language.words_of(None)
    every = "".join(map(chr, range(0x110000)))
    assert "".join(language.words_of(every)) == "".join(c for c in every.lower() if c.isalpha())


def test_a_text_of_words_with_numerals_has_a_language(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(corpora())]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.predict(spark.createDataFrame([(1, "schung² einung₂ schein³ "), (2, "²½")], "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], r["score"] > 0, r["rejected"]) for r in got] == [("bb", True, False), ("und", False, True)]


@pytest.mark.parametrize("rows", [[], [(1, None, "aa"), (2, "x", None)], [(1, "12 ...", "aa"), (None, "", "bb")]])
def test_nothing_to_learn_from(spark, rows):
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == []
    df = spark.createDataFrame([(1, "some words"), (2, None), (3, "12"), (None, "x")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in language.predict(df, model).collect()] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)]
    assert [r["doc_id"] for r in language.keep_known(df, model).collect()] == [1, None]
    assert language.predict(df.limit(0), model).collect() == []


@pytest.mark.parametrize("rows", [0, 3])
def test_the_query_on_a_table_without_labels(spark, tmp_path, rows):
    from millrace.llm import queries

    spark.createDataFrame([(k, "text", None, "s", 4) for k in range(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_language(spark, str(tmp_path)).collect()
    assert [r["lang_pred"] for r in got] == ["und"] * rows


def test_long_words_are_scored_in_parts(monkeypatch):
    model = language.fit({lang: Counter(w for g, t in corpora() if g == lang for w in t.split()) for lang in ("aa", "bb", "cc")})
    words = ["laou" * 900, "x", "schung" * 50, "que"] * 5
    want = model.word_costs(words)
    for part in (7, 64, 1001):
        monkeypatch.setattr(language, "PART", part)
        assert np.allclose(model.word_costs(words), want)
    monkeypatch.setattr(language, "CACHE_CHARS", 1000)
    scorer = language.Scorer(model)
    for text in ("laou" * 900 + " x", "que x", "laou" * 900):
        assert np.allclose(scorer.entropy(text)[0], language.Scorer(model).entropy(text)[0])


def test_ties_take_the_first_name(spark):
    rows = [(k, "la ou que", lang) for k, lang in enumerate(["zz", "aa", "mm"])]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language.predict(spark.createDataFrame([(1, "ou la")], "doc_id long, text string"), model).collect()
    assert got[0]["lang_pred"] == "aa" and got[0]["score"] == pytest.approx(1 / 3)


def test_predictions_by_brute_force(spark):
    """Every column of a prediction from the definitions: words, costs, calibration, score and rejection."""
    train, apart = corpora(1, 60), corpora(2, 30)
    counts = {lang: Counter(w for g, t in train if g == lang for w in t.lower().split()) for lang in ("aa", "bb", "cc")}
    model = language.fit(counts)
    language.calibrate(model, apart)
    alphabet = len({c for t in counts.values() for w in t for c in w}) + 1
    cost = {lang: reference(c, language.ORDER, alphabet) for lang, c in counts.items()}
    known = {}

    def bits(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            return None, 0
        chars = sum(len(w) + 1 for w in words)
        out = []
        for lang in sorted(counts):
            for w in set(words) - {k[1] for k in known if k[0] == lang}:
                s = "\x01" + w + "\x02"
                known[lang, w] = sum(cost[lang](s[max(0, i - language.ORDER + 1) : i], s[i]) for i in range(1, len(s)))
            out.append(sum(known[lang, w] for w in words) / chars)
        return out, chars

    seen = [(sorted(counts).index(lang), *bits(t)) for lang, t in apart]
    ceiling = lambda n: max([min(b) for _, b, c in seen if int(math.log2(c)) >= int(math.log2(n))] or [max(min(b) for _, b, _ in seen)]) + language.MARGIN
    loss = lambda z: sum(math.log(sum(math.exp(z * (min(b) - x)) for x in b)) - z * (min(b) - b[k]) for k, b, _ in seen)
    sharp = min((2.0**k for k in range(-2, 7)), key=loss)
    texts = [t for _, t in corpora(3, 15)] + ["12", None, "", "Zyxw qq", "THE tion-on 4", "la", "zzzz " * 30, "CO2 ou"]
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r, text in zip(got, texts, strict=True):
        b, chars = bits(text)
        if not chars:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        assert r["lang_pred"] == sorted(counts)[b.index(min(b))] and r["entropy"] == pytest.approx(min(b))
        assert r["score"] == pytest.approx(1 / sum(math.exp(sharp * (min(b) - x)) for x in b)) and r["rejected"] == (min(b) > ceiling(chars))
    assert any(r["rejected"] and r["lang_pred"] != "und" for r in got) and not all(r["rejected"] for r in got)
