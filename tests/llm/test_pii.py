import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            alternate = sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits)))
            if (kind != 1 or all(int(p) <= 255 for p in m[0].split("."))) and (kind != 2 or (14 <= len(digits) <= 19 and alternate % 10 == 0)) and (kind != 3 or 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "1", "23", "255", "300", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "x@y.zz", "+1 (555) 555-1234", "10.0.0.1", "\n", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 200000, "1" * 200000, "1." * 100000, "+1 " * 60000, "@" * 100000, "a@" * 60000, "+" + "1 ." * 60000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def potentials():
    return pii.Potentials.of(pii.Counter({("label", k): 10 for k in range(5)} | {("skip", 1): 10}))


def test_similar_mentions_take_the_label_and_others_do_not():
    text = "Call +1 (555) 123-4567 or 555 123 4567, not 999 888 7777. Mail joan.doe7@mail.example or joan.doe7 [at] mail [dot] example; joan.doe7 said 12345678."
    spans = pii.base_spans(text)
    more = pii.added_spans(text, spans, potentials())
    assert [(text[s:e], pii.KINDS[k]) for s, k, e in more] == [("555 123 4567", "phone"), ("joan.doe7 [at] mail [dot] example", "email"), ("joan.doe7", "email")]
    assert pii.added_spans("555 123 4567 and 555 123 4567", [], potentials()) == []


@pytest.mark.parametrize("repeats", [1, 5, 50, 500])
@pytest.mark.parametrize(("skip", "unary"), [(8.0, -2.0), (3.0, -2.0), (3.4, -0.5)])
@pytest.mark.parametrize("first", [True, False])
def test_every_repeat_takes_the_label_of_one_base_mention(repeats, skip, unary, first):
    field = pii.Potentials({}, np.array([0.0] + [unary] * 4), np.zeros((5, 5)), skip)
    for base, bare, kind in [("+1 (555) 123-4567", "555 123 4567", 3), ("joan.doe7@mail.example", "joan.doe7", 0)]:
        parts = [base] + [bare] * repeats if first else [bare] * repeats + [base]
        text = (" " + "so it goes on, " * 4).join(parts)
        more = pii.added_spans(text, pii.base_spans(text), field)
        assert [(text[s:e], k) for s, k, e in more] == [(bare, kind)] * repeats
        near = "; ".join(parts)
        assert len(pii.added_spans(near, pii.base_spans(near), field)) == repeats


def test_skip_edges_grow_with_the_nodes_and_reach_the_nearest_base_mention():
    nodes = [pii.Mention(10 * k, 10 * k + 5, "a", 3 if k in (0, 7) else -1) for k in range(10)]
    assert sorted(pii.edges_of(nodes)[1]) == sorted({(k, k + 1) for k in range(9)} | {(0, 2), (0, 3), (4, 7), (5, 7), (7, 9)})
    assert len(pii.edges_of(nodes * 100)[1]) <= 2 * 1000


def test_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, pairs, tables = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]]), rng.normal(size=(3, 3, 3))
    joint = np.zeros((3,) * 4)
    for x in np.ndindex(*joint.shape):
        joint[x] = np.exp(sum(unary[k, x[k]] for k in range(4)) + sum(t[x[a], x[b]] for (a, b), t in zip(pairs, tables, strict=True)))
    joint /= joint.sum()
    want = np.array([joint.sum(axis=tuple(j for j in range(4) if j != k)) for k in range(4)])
    assert np.allclose(pii.propagate(unary, pairs, tables, 200), want, atol=1e-3)


def test_frames(spark):
    rows = [(1, None), (None, ""), (2, "mail ann.lee@host.example, again ann.lee"), (2, "mail ann.lee@host.example, again ann.lee"), (3, "x " * 50000 + "10.0.0.1")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, id string, n_ip int")
    found = pii.find(df, pii.train(df)).collect()
    assert [(r["id"], r["n_email"], r["n_ip"]) for r in found] == [(1, 0, 0), (None, 0, 0), (2, 1, 0), (2, 1, 0), (3, 0, 1)]
    assert found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[2]["spans"] == "email:5:25,email:33:40"
    clean = pii.redact(df, potentials()).collect()
    assert [r["text"] for r in clean][:3] == [None, "", "mail <EMAIL>, again <EMAIL>"] and clean[2]["id"] == "a"
    assert pii.find(df.limit(0), pii.train(df.limit(0))).collect() == []


def test_potentials_are_counted_on_every_document(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 7, "card 4111 1111 1111 1111").otherwise("ip 10.0.0.1").alias("text"))
    field, n = pii.train(df), np.array([0, 0, 29_997, 3, 0]) + 1
    assert np.allclose(field.prior, np.log(n / n[0]))


@pytest.mark.parametrize(("text", "want"), [
    ("mail anna@host.example now; ask anna, Anna. Not annabel.", [("anna", 0), ("Anna", 0)]),
    ("a@b.example, then a", [("a", 0)]),
    ("host 10.0.0.1 is down; 10-0-0-1 and 10001 too, 10-0-0-2 is not", [("10-0-0-1", 1), ("10001", 1)]),
    ("host 192.168.0.1 and then 192 168 0 1 and 8 0 1", [("192 168 0 1", 1)]),
    ("card 4111 1111 1111 1111 or " + "  ".join("4111111111111111") + "  or  12", [("  ".join("4111111111111111"), 2)]),
    ("mail 5551234@host.example or 5551234", [("5551234", 0)]),
])
def test_mentions_equal_to_a_base_span_have_no_length_floor(text, want):
    found = pii.added_spans(text, pii.base_spans(text), potentials())
    assert [(text[s:e], k) for s, k, e in sorted(found)] == want


def test_long_numbers_equal_to_a_base_span_are_nodes():
    loose = "- ".join("4111111111111111110")
    ip = "0" * 20 + "10.0.0.1"
    text = f"card 4111 1111 1111 1111 110, {loose}; host {ip}, {ip.replace('.', '-')}, {'9' * 20}"
    nodes = pii.mentions(text, pii.base_spans(text))
    assert [text[m.start : m.end] for m in nodes if m.base < 0] == [loose, ip.replace(".", "-")] and len(loose) > 48


def exact(unary, pairs, tables):
    """Marginals by all labellings."""
    n, k = unary.shape
    total = np.full((k,) * n, -np.inf)
    for x in np.ndindex(*total.shape):
        total[x] = sum(unary[i, x[i]] for i in range(n)) + sum(t[x[a], x[b]] for (a, b), t in zip(pairs, tables, strict=True))
    joint = np.exp(total - total.max())
    joint /= joint.sum()
    return np.array([joint.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)])


@pytest.mark.parametrize("seed", range(12))
def test_added_spans_are_those_of_all_labellings(seed):
    """Small documents with cycles: what has more than half of the exact probability is added, and nothing else."""
    rng = random.Random(seed)
    bits = ["+1 (555) 123-4567", "555 123 4567", "joan.doe7@mail.example", "joan.doe7", "4111 1111 1111 1111", "4111111111111111", "99 555 123 4567", "10.0.0.1", "10-0-0-1", "77 88 99 00 11"]
    text = ", ".join(rng.choice(bits) + rng.choice(["", " and some more words that part them well"]) for _ in range(6))
    chain = np.array([[rng.uniform(-1, 1) for _ in range(5)] for _ in range(5)])
    grades = {"name 9 mixed": rng.uniform(0, 4), "whole 10": rng.uniform(0, 4), "end 12": rng.uniform(0, 4), "whole 12": rng.uniform(0, 4)}
    field = pii.Potentials({}, np.array([0.0] + [rng.uniform(-2, -0.5) for _ in range(4)]), chain + chain.T, 3.0, grades)
    spans = pii.base_spans(text)
    known = pii.Known.of(text, spans)
    nodes = pii.mentions(text, spans, known)
    want = []
    if spans:
        marginal = exact(*pii.field_of(text, nodes, known, field))
        want = [(m.start, int(p.argmax()) - 1, m.end) for m, p in zip(nodes, marginal, strict=True) if m.base < 0 and p.argmax() and p.max() > 0.5]
        near = {m.start for m, p in zip(nodes, marginal, strict=True) if abs(np.sort(p)[-1] - 0.5) < 0.1}  # loopy messages are approximate
    got = pii.added_spans(text, spans, field)
    assert [s for s in got if not spans or s[0] not in near] == [s for s in want if s[0] not in near]


def planted(n=400, seed=9):
    """Documents with personal data, repeats of it to be found, and common words that mail names equal by chance."""
    rng = random.Random(seed)
    common = ["info", "sales", "the", "mail", "team", "us"]
    rows, truth = [], []
    for k in range(n):
        words = [rng.choice([*common, "and", "note", "about", "people", "work", "10 20,", "call", "12345678,"]) for _ in range(60)]
        own = []
        kind = k % 3
        if kind == 0:
            name = f"j{rng.randrange(10**6)}.doe"
            words[5], own = f"{name}@host.example", [name]
        elif kind == 1:
            words[5] = f"{rng.choice(common)}@host.example"
        else:
            d = f"{rng.randrange(10**9, 10**10)}"
            words[5], own = f"+1 {d[:3]} {d[3:6]} {d[6:]},", [f"{d[:3]}-{d[3:6]}-{d[6:]}", f"1{d}"]
        for place, value in zip(rng.sample(range(8, 60), len(own) * 2), own * 2, strict=True):
            words[place] = f"at {value},"
        text = " ".join(words)
        rows.append((k, text))
        truth.append({(m.start(), m.end()) for value in own for m in re.finditer(f"(?<![\\w.@]){re.escape(value)}(?![\\w@])", text)})
    return rows, truth


def test_precision_and_recall_of_added_spans(spark):
    rows, truth = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(df)
    found = [{(s, e) for s, _, e in pii.added_spans(t, pii.base_spans(t), field)} for _, t in rows]
    hit = sum(len(a & b) for a, b in zip(found, truth, strict=True))
    assert hit / sum(map(len, truth)) >= 0.98 and hit / sum(map(len, found)) >= 0.98
    assert field.grades["name 4 letters"] < 0.5 < field.grades["name 9 mixed"]
