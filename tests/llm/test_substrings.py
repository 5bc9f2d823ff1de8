import hashlib
import random
import re

import pytest

from millrace.llm import substrings


def brute(rows, window=20):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = {}, []
    covered = {k: set() for k in order}
    for k in order:
        for s in range(len(split[k]) - window + 1):
            w = tuple(split[k][s : s + window])
            here = (rows[k], s)
            if seen.setdefault(w, here) != here:
                covered[k].update(range(s, s + window))
    for k in order:
        kept = [w for j, w in enumerate(split[k]) if j not in covered[k]]
        out.append((rows[k][0], len(split[k]), len(covered[k]), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "x1"]) if rng.random() < 0.3 else "".join(rng.choice("abcdef") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 33, 60, 150)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            words += p[cut : cut + rng.randint(15, 200)]
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(300, None), (301, " \n"), (302, "of " * 3000), (303, "a b c " * 50), (304, "of " * 30), (None, rows[5][1]), (7, rows[7][1]), (305, "w " * 19), (306, " ".join(f"q{j % 23}" for j in range(300)))]
    return rows


@pytest.mark.parametrize("hot_least", [2_000, 5])
def test_equals_brute_force(spark, monkeypatch, hot_least):
    monkeypatch.setattr(substrings, "HOT_SHARE", 10**9)
    rows = corpus(hot_least)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if hot_least == 5:
        monkeypatch.setattr(substrings, "SEGMENT", 7)
        monkeypatch.setattr(substrings, "PART_CHARS", 2000)
    got = substrings.deduplicate(df, filter_bits=20, hot_least=hot_least).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_hot_run_in_many_contexts_and_one_word_repeated(spark):
    """A run of 8 words that all documents share, each between words of its own, some of them twice; and one long run."""
    rng = random.Random(3)
    common = " ".join(f"c{k}" for k in range(8))
    around = [" ".join(f"{rng.randrange(10**6)}" for _ in range(14)) for _ in range(40)]
    rows = [(k, f"{around[k % 37]} {common} {around[(k * 7) % 39]}") for k in range(300)] + [(1000, "of " * 200_000), (1001, "of " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in substrings.deduplicate(df, filter_bits=20, hot_least=20).collect()}
    # every window but the first also starts earlier; the first word is covered by the first window alone
    assert got[1000]["n_removed"] == 199_999 and got[1001]["n_removed"] == 25
    assert sorted((tuple(r) for r in got.values() if r["id"] < 1000), key=str) == brute(rows[:300])


def test_parts_of_a_group_and_small_shards(monkeypatch):
    """The streamed steps alone, with parts and shards so small that groups span several."""
    window, text = 4, ["a b c d e f", "a b c d e f", "x b c d e y", "a b c d e f", "b c d e", "a a a a a a a"]
    group = [(0, k, 0, 0, len(t.split()) - window + 1, t) for k, t in enumerate(text)]
    for shard in (1, 10**6):
        monkeypatch.setattr(substrings, "SHARD_CHARS", shard)
        found = list(substrings.locate([group], [substrings.confirm(group, set(), window)], set()))
        assert [substrings._joined(r) for _, r in found] == [[], [(0, 3)], [(1, 1)], [(0, 3)], [(0, 1)], [(1, 3)]]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, did string, th int, start string")
    assert substrings.deduplicate(df, with_text=True).collect() == []
