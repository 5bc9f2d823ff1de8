import math
from functools import partial

import numpy as np
import pytest

from millrace.llm import embeddings


def brute(rows, cosine=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    units = [unit(v) if label is not None else None for _, v, label in rows]
    links = [[j for j in range(len(rows)) if j != i and units[i] and units[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and sum(a * b for a, b in zip(units[i], units[j])) >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "block_pairs", partial(embeddings.block_pairs, fan=4))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] + rng.normal(size=8) * 0.09], k % 2) for k in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 8, 0), (205, [1.0, None], 0), (206, [math.nan, 1.0], 0), (207, [math.inf, 1.0], 0), (208, [3 * x for x in rows[1][1]], 1), (209, [], 1), (210, rows[0][1][:3], 0), (5, rows[5][1], 1), (None, rows[6][1], 0), (211, [1e-30] * 8, 1), (212, [2e-30] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in embeddings.near_duplicates(df, block=block).collect()), key=str) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, h1 string, block int, n_links int")
    assert embeddings.near_duplicates(df).collect() == []
