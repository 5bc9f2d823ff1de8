"""Steps whose cost must grow with the tables, not with the square of what has one name."""

import re

from pyspark.sql import functions as F

from millrace.operators import linking, resolve
from millrace.plans import queries
from millrace.plans.model import PART, Model


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_meet_by_cells_of_keys(spark, tmp_path):
    keys = [1, 2, 39, 40, 41, 42, 79, 80, 81, 121, 160, 161, 500]
    parts = [(k, n) for k in keys for n in ("Red  box",)] + [(43, "red box"), (44, "blue box"), (45, None), (84, "Blue Box")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    links = Model(spark, str(tmp_path)).links()
    name = lambda n: " ".join(n.split()).lower() if n else None
    want = [(PART + a, PART + b) for a, x in parts for b, y in parts if x and y and name(x) == name(y) and 0 < abs(a - b) <= 40]
    assert rows(links, "subject_entity_id", "target_entity_id") == sorted(want, key=str)
    # a name alone is no join key: with one name on all parts the rows that meet would be the square of the parts
    assert "cell" in next(line for line in plan(links).splitlines() if "Join Inner" in line)


def test_walks_read_a_stored_graph(spark, monkeypatch):
    built = []
    monkeypatch.setattr(queries, "_graph", lambda m, f=queries._graph: built.append(1) or f(m))
    left = []
    monkeypatch.setattr(queries, "discard", lambda df, f=queries.discard: left.append(df._millrace_path) or f(df))
    assert queries.QUERIES["bfs_reachable_depth"](spark, "/root/testdata/sf0.001").count() >= 1
    assert len(built) == 1 and len(left) == 2


def test_tiers_compare_names_not_rows(spark):
    names = ["red box", "Red  box", "the red boxes", "blue bag"]
    places = [("d", "t"), ("e", "t")]
    rows_of = [(k, *places[k % 2], names[k // 2 % 4]) for k in range(400)] + [(400, "d", "t", None), (401, None, "t", "red box"), (402, "d", "t", "red bo"), (403, "d", "t", "zz")]
    mentions = spark.createDataFrame(rows_of, "mention_id long, domain string, type string, name string")
    entities = mentions.filter("mention_id < 400").select(F.col("mention_id").alias("id"), "domain", "type", "name")
    none = spark.createDataFrame([], "entity_id long, alias string")
    found = resolve.candidate_tiers(mentions, entities, none, threshold=0.9)
    got = {r["mention_id"]: (r["entity_id"], r["tier"]) for r in found.collect()}
    least = {"red box": 0, "Red  box": 0, "the red boxes": 4, "blue bag": 6}
    assert got == {k: (least[n] + k % 2, 1) for k, _, _, n in rows_of[:400]} | {400: (None, None), 401: (None, None), 402: (0, 5), 403: (None, None)}
    # the rows of a name are one row before any join
    assert re.search(r"Aggregate \[domain#\d+L?, type#\d+L?, name#\d+L?\], \[.*min\(", plan(found))


def test_pairs_of_a_large_group_meet_by_slices(spark, monkeypatch):
    monkeypatch.setattr(linking, "SLICE", 8)
    made = [(k, "t", ("Red  box", "red box")[k % 2], "abc"[k % 3]) for k in range(60)] + [(60, "u", "red box", "a"), (61, "t", "lone", "a"), (62, "t", None, "b"), (63, "t", "red box", None)]
    entities = spark.createDataFrame(made, "id long, type string, name string, domain string")
    group = [(k, d or "") for k, t, n, d in made if t == "t" and n and n != "lone"]
    want = sorted(((a, b) for a, x in group for b, y in group if x < y), key=str)
    pairs = linking.cross_domain_pairs(entities)
    assert rows(pairs) == want
    some = spark.createDataFrame([(3,), (7,), (63,)], "x long")
    near = linking.cross_domain_pairs(entities, some)
    assert rows(near) == [p for p in want if {3, 7, 63} & set(p)] == rows(linking.touching(pairs, some))
    # a type and name alone are no join key, and pairs are not shuffled to find those with a candidate
    assert "sb#" in next(line for line in plan(pairs).splitlines() if "Join Inner" in line and "<" in line)
    assert plan(near).splitlines()[0].startswith("Project") and "Join Inner" in plan(near).splitlines()[1]


def test_chunks_carry_the_language(spark, tmp_path):
    docs = [(1, "a" * 1900, "en"), (2, "short", None), (2, "twice", "de"), (3, " ", "en"), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = Model(spark, str(tmp_path)).chunks()
    assert rows(chunks, "chunk_id", "start_offset", "end_offset", "domains") == [(1000, 0, 1000, ["en"]), (1001, 900, 1900, ["en"]), (2000, 0, 5, ["de"]), (2000, 0, 5, [None])]
    assert "Join" not in plan(chunks)
