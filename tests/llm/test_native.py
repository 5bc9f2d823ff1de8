"""The operators made of built-in functions only: preference formatting, quality rules; and mixing."""

import hashlib
import random
import re
from collections import Counter

import pytest

from millrace.llm import mixing, preference, quality

NATIVE = ("preference", "quality", "mixing")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_brute(text):
    w, whole = words(text), text or ""
    at = [i for i in range(len(w) - 7)]
    n = Counter(tuple(w[i : i + 8]) for i in at)
    covered = {j for i in at if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in whole.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", whole)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements(spark):
    rng = random.Random(1)
    bits = ["a", "bb", "é漢", "#x", "|", "\n", "\x0b", " ", "  ", "a b c d e f g h\n", "line\n"]
    texts = [None, "", " \n\t", "x " * 50000, "a b c d e f g h " * 3] + ["".join(rng.choice(bits) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    df = spark.createDataFrame([(k % 140, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, words int, failed int")
    got = quality.ledger(df).collect()
    assert len(got) == len(texts)
    assert sorted(tuple(r)[1:7] for r in got) == sorted(quality_brute(t) for t in texts)
    assert quality.ledger(df.limit(0)).collect() == []


def test_policies_and_ablations(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,), (3,), (16,), (17,)], "failed long")
    assert [r["kept"] for r in quality.apply_policy(rows, "base").collect()] == [True, True, False, False, True, False]
    got = {r["rule"]: tuple(r)[1:] for r in quality.ablations(rows, "v1").collect()}
    assert got["few_words"] == (3, 1, 3) and got["symbols"] == (2, 1, 3) and got["long_words"] == (0, 0, 2)


def preference_brute(turns):
    convs = {}
    for c, n, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((n, role, text))
    low = lambda x: (x is not None, x)
    convs = {c: [t[1:] for t in sorted(ts, key=lambda t: tuple(map(low, t)))] for c, ts in convs.items()}
    heads = {}
    for c in sorted(convs):
        heads.setdefault(convs[c][0], []).append(c)
    show = lambda t: f"<|{t[0] or ''}|>\n{t[1] or ''}<|end|>\n"
    mask = lambda ts: ",".join(f"{len(show(t))}:{int(t[0] == 'assistant')}" for t in ts)
    text = lambda ts: "".join(map(show, ts))
    out = []
    for first, *others in heads.values():
        a = convs[first]
        if not others:
            cut = max((k for k, t in enumerate(a) if t[0] == "assistant"), default=len(a))
            out.append((first, None, cut, text(a[:cut]), text(a[cut:]), mask(a[cut:]), None, None))
        for c in others:
            b = convs[c]
            cut = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            out.append((first, c, cut, text(a[:cut]), text(a[cut:]), mask(a[cut:]), text(b[cut:]), mask(b[cut:])))
    return sorted(out, key=str)


def test_preference_pairs(spark):
    rng = random.Random(2)
    turns = []
    for c in range(40):
        turns += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é漢", None, ""])) for k in range(rng.randint(1, 5))]
    turns += [(5, 0, "user", "hi"), (5, 0, "user", "hi"), (None, 0, "user", "hi"), (50, None, "user", "hi"), (51, 0, "user", "w " * 40000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, n string")
    assert sorted((tuple(r) for r in preference.preference_format(df).collect()), key=str) == preference_brute(turns)
    assert preference.preference_format(df.limit(0)).collect() == []


def test_native_plans_have_no_python(spark):
    for plan in (preference.preference_format(spark.createDataFrame([(1, 1, "user", "t")], "conv_id long, turn long, role string, text string")), quality.apply_policy(quality.ledger(spark.createDataFrame([(1, "t")], "doc_id long, text string")))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", ""))


def mixing_brute(rows, weights=(1, 2, 3)):
    size = [len(words(t)) for _, t, _ in rows]
    h = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:9], 16) for i, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), sum(size)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        for s in over or open_:
            target[s] = 3 * total[s] if over else share[s]
        left -= sum(3 * total[s] for s in over)
        open_ = open_ - set(over) if over else set()
    out = []
    for s in sources:
        own = [k for k in range(len(rows)) if rows[k][2] == s]
        copies = int(target[s] // total[s]) if total[s] else 0
        rest, upto, taken = target[s] - copies * total[s], 0, set()
        for v in sorted({h[k] for k in own}):
            leaf = sum(size[k] for k in own if h[k] == v)
            if upto + leaf <= rest or (upto <= rest < upto + leaf and 2 * upto + leaf <= 2 * rest and leaf):
                taken.add(v)
            upto += leaf
        out += [(rows[k][0], size[k], total[s], round(target[s], 6), size[k] * (copies + (h[k] in taken))) for k in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(k, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "B", "é", None, "z"]) if rng.random() < 0.6 else "hot") for k in range(120)]
    rows += [(None, "w w", "a"), (3, rows[3][1], rows[3][2]), (200, None, "a"), (201, "w " * 30000, "long"), (202, "", "empty")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, h string, copies int")
    found = mixing.mix(df).collect()
    assert sorted(((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found), key=str) == mixing_brute(rows)
    mixed = mixing.take(df)
    assert mixed.columns == df.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in found)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.take(df.limit(0)).collect() == []
