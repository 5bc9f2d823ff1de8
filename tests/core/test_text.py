import pytest
from pyspark.sql import functions as F

from millrace.functions import stemming, text


@pytest.mark.parametrize(
    ("word", "stem"),
    [("running", "run"), ("gates", "gate"), ("generously", "generous"), ("consistency", "consist"), ("knightly", "knight"), ("cries", "cri"), ("by", "by"), ("ties", "tie"), ("happiness", "happi"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("national", "nation"), ("succeed", "succeed"), ("universities", "univers"), ("dogs", "dog"), ("agreed", "agre"), ("controlling", "control"), ("sensational", "sensat"), ("rational", "ration"), ("dependent", "depend")],
)
def test_english(word, stem):
    assert stemming.english(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("важная", "важн"), ("вавиловка", "вавиловк"), ("книги", "книг"), ("книгами", "книг"), ("бегавшая", "бега"), ("поднявшись", "подня"), ("красивейший", "красив"), ("новость", "новост"), ("программирование", "программирован"), ("ёлка", "елк")])
def test_russian(word, stem):
    assert stemming.russian(word) == stem


@pytest.mark.parametrize(("a", "b", "value"), [("martha", "marhta", 0.961111), ("abcd", "axyz", 0.55), ("abcdefgh", "bcadefgh", 0.9375), ("dixon", "dicksonx", 0.813333), ("Course Platform", "course  platform", 1.0), ("", "a", 0.0)])
def test_jaro_winkler(a, b, value):
    assert text.jaro_winkler_py(a, b) == pytest.approx(value, abs=1e-6)


def test_columns_agree_with_python(spark):
    names = ["The City  of Ash", "city of ash", "a", "An", "theater", "Égypte", "Москва", "漢字", " x y ", "", "1 Ж"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.normalize(F.col("n")).alias("a"), text.match_key(F.col("n")).alias("m"), text.stem_key("n").alias("s"), text.script(F.col("n")).alias("c"), text.bigrams(F.col("n")).alias("b")).collect()
    for r in rows:
        assert (r["a"], r["m"], r["s"], r["c"]) == (text.normalize_py(r["n"]), text.match_key_py(r["n"]), text.stem_key_py(r["n"]), text.script_of(r["n"]))
        key = text.normalize_py(r["n"])
        assert r["b"] == (list(dict.fromkeys(key[i : i + 2] for i in range(len(key) - 1))) if len(key) > 1 else [key])


def test_times(spark):
    good = {"2024-01-02 03:04:05": 1704164645, "2024-01-02T03:04:05Z": 1704164645, "2024-01-02T03:04:05.123456789+01:00": 1704161045}
    bad = ["2024-01-02", "2024-01-02 24:00:00", "2024-13-02 00:00:00", "2024-01-02T03:04:05", "x", None]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", text.parse_time(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == good | dict.fromkeys(bad)
