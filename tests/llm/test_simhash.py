import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def brute(rows, words=4, radius=4):
    def mark(text):
        found = (text or "").encode().lower().split()
        if not found:
            return 0
        grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(marks[a] ^ marks[b]).count("1") <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, marks[k], least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (3, 30, 60, 200)]
    rows = []
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "zz"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (None, base[1]), (3, rows[3][1]), (4, base[2]), (203, "É " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slice_rows in (16384, 20):
        got = [(r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(df, words=4, slice_rows=slice_rows).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id long, fingerprint string, component_id int")
    assert simhash.near_duplicates(df).collect() == []


@pytest.mark.parametrize("small", [0, 128])
def test_kernel_connects_what_brute_force_connects(small):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.int64).view(np.uint64)
    marks = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for c in centre])
    groups = np.sort(rng.integers(0, 4, len(marks)))
    a, b = simhash.link_sorted(groups, marks, 4, small)
    for g in range(4):
        own = np.unique(marks[groups == g])
        where = {m: k for k, m in enumerate(own.tolist())}
        near = np.array([[bin(int(x) ^ int(y)).count("1") <= 4 for y in own] for x in own])
        i, j = np.nonzero(near)
        want = simhash.least_labels(len(own), i, j)
        pairs = [(where[int(x)], where[int(y)]) for x, y in zip(a, b, strict=True) if int(x) in where and int(y) in where]
        assert all(near[i, j] or want[i] == want[j] for i, j in pairs)
        p, q = (np.array([x[k] for x in pairs], int) for k in (0, 1))
        assert (simhash.least_labels(len(own), p, q) == want).all()
