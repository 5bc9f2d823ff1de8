import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import jaro_winkler_py, match_key_py, normalize_py, stem_key_py
from millrace.operators import catalog, extract, fusion, graph, lexical, linking, maintenance, resolve, search, vectors
from millrace.operators.components import connected_components


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (-5, 130)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert rows(connected_components(df)) == sorted(label.items(), key=str)
    assert connected_components(df.limit(0)).collect() == []


def test_fusion_golden(spark):
    lex = spark.createDataFrame([(1, -2.0), (2, -1.0)], "chunk_id long, bm25 double")
    sem = spark.createDataFrame([(2, 0.1), (3, 0.2)], "chunk_id long, distance double")
    got = [(r["chunk_id"], round(r["score"], 6), r["source_type"]) for r in fusion.fuse(lex, sem).collect()]
    assert got == [(2, 0.7, "hybrid"), (1, 0.331818, "lexical"), (3, 0.15, "semantic")]
    assert [r["score"] for r in fusion.fuse(lex.filter("chunk_id = 1"), sem.limit(0), 0).collect()] == [0.5]
    assert len(fusion.fuse(lex, sem, top_n=1).collect()) == 1
    zero = spark.createDataFrame([(1, 0.0)], "chunk_id long, distance double")
    assert fusion.standalone(zero, "semantic").first()["score"] == fusion.DOUBLE_MAX


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1.0, False, False, None, -(10**9), "s", 1), (2, 1.0, True, True, None, -(10**9), "s", 2), (3, 1.0, None, False, 99, 100, None, 3)], "chunk_id long, score double, is_official boolean, is_deprecated boolean, valid_to long, updated_at long, doc_source_type string, prior int")
    got = {r["chunk_id"]: (round(r["score"], 6), r["rank"]) for r in fusion.rerank(df, 100, fusion.Boosts(authority={"s": 2.0}, official=-1)).collect()}
    assert got == {1: (2.0, 1), 2: (0.6, 2), 3: (0.12, 3)}


@pytest.mark.parametrize(("query", "ids"), [("quick fox", {1}), ("quick OR dog", {1, 2, 3}), ('"brown fox"', {1}), ("qui*", {1, 3}), ("quick NOT fox", {3}), ("(fox OR dog) AND lazy", {2}), ("ÉTÉ", {3}), ('"the qui"*', {1}), (" ", set())])
def test_lexical(spark, query, ids):
    df = spark.createDataFrame([(1, "The quick brown fox", ["a"]), (2, "a lazy dog", ["b"]), (3, "quick été", ["A"])], "chunk_id long, search_text string, domains array<string>")
    assert {r["chunk_id"] for r in lexical.search(df, query).collect()} == ids
    assert {r["chunk_id"] for r in lexical.search(df, query, domain=" A ").collect()} == ids & {1}


@pytest.mark.parametrize("query", ["(", "a AND", "NOT a", "OR", "a )", "a + b", '"a'])
def test_malformed_queries_raise(query):
    with pytest.raises(lexical.QueryError):
        lexical.parse(query)


def test_limits():
    assert [lexical.limited(n) for n in (-1, 0, 1, 100, 101)] == [20, 20, 1, 100, 20]
    assert catalog.page_size(500) == 20 and catalog.decode_cursor(catalog.encode_cursor(20, 10)) == (20, 10)
    assert catalog.next_cursor(0, 10, 10) is None
    for bad in ("x", catalog.base64.b64encode(b"{}").decode()):
        with pytest.raises(ValueError):
            catalog.decode_cursor(bad)


def test_vectors(spark):
    log = spark.createDataFrame([(1, 1, False, [1.0, 0.0]), (1, 2, False, [0.0, 1.0]), (2, 1, False, [1.0, 1.0]), (2, 3, True, None), (3, 1, False, [0.0, 1.0])], "chunk_id long, version long, deleted boolean, embedding array<float>")
    live = vectors.latest(log)
    assert rows(live, "chunk_id", "embedding") == [(1, [0.0, 1.0]), (3, [0.0, 1.0])]
    assert rows(vectors.top_k(live, [0.0, 1.0], 1)) == [(1, 0.0)]
    again = vectors.latest(vectors.appended(log, spark.createDataFrame([(2, [5.0, 5.0])], "chunk_id long, embedding array<float>")))
    assert rows(again, "chunk_id") == [(1,), (2,), (3,)]
    assert vectors.stale_share(log).first()["compact"]
    with pytest.raises(Exception, match="length differs"):
        vectors.top_k(live, [0.0], 1).collect()


def test_hybrid_degrades(spark):
    chunks = spark.createDataFrame([(1, 1, "alpha beta", ["hr"]), (2, 1, "beta", ["it"])], "chunk_id long, doc_id long, search_text string, domains array<string>")
    docs = spark.createDataFrame([(1, "p", "t", ["hr"], False, False, 0)], "id long, original_path string, source_type string, domains array<string>, is_official boolean, is_deprecated boolean, updated_at long")
    table = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id long, embedding array<float>")

    def broken(_):
        raise RuntimeError("no model")

    with pytest.warns(UserWarning, match="semantic"):
        got = search.hybrid(chunks, docs, table, "alpha", broken, 10).collect()
    assert [(r["chunk_id"], r["source_type"]) for r in got] == [(1, "lexical")]
    with pytest.raises(RuntimeError, match="no model"), pytest.warns(UserWarning):
        search.hybrid(chunks, docs, table, "alpha", broken, 10, settings=search.Settings(use_lexical=False))
    assert search.hybrid(chunks, docs, table, " ", broken, 10).collect() == []
    with pytest.raises(ValueError, match="top_k"):
        search.hybrid(chunks, docs, table, "a", broken, 10, top_k=0)


def bfs(nodes, edges, start, o):
    limit, room = min(o.max_depth or 5, 10), (o.max_nodes or 1000) - 1
    depth, out, frontier = {start: 0}, [], [start]
    for d in range(1, limit + 1):
        new = []
        for p in sorted(frontier):
            steps = []
            for f, t, r, k in edges:
                if (k == "link" and not o.follow_links) or (o.relations and r not in o.relations):
                    continue
                if f == p and o.direction in ("out", "both"):
                    steps.append((k == "link", f, t, r, t, k))
                if t == p and o.direction in ("in", "both"):
                    steps.append((k == "link", f, t, r, f, k))
            for _, f, t, r, n, k in sorted(steps):
                if n in depth or n in new:
                    continue
                if k == "fact" and nodes[n] != nodes[start]:
                    continue
                if room <= 0:
                    return depth | dict.fromkeys(new, d), out
                room -= 1
                new.append(n)
                out.append((f, t, r, k, d))
        depth |= dict.fromkeys(new, d)
        frontier = new
    return depth, out


@pytest.mark.parametrize("seed", range(3))
def test_traversal_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    nodes = {k: rng.choice("ab") for k in range(30)}
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice("xy"), rng.choice(["fact", "fact", "link"])) for _ in range(60)]
    g = graph.nodes(spark.createDataFrame([(k, "t", f"n{k}", d) for k, d in nodes.items()], "id long, type string, name string, domain string"))
    e = spark.createDataFrame(edges, "from_id long, to_id long, relation string, kind string")
    o = [graph.Options(follow_links=True), graph.Options(3, 6, "out", follow_links=True), graph.Options(direction="both", relations=("x",))][seed]
    depth, out = bfs(nodes, edges, 0, o)
    seen, found = graph.traverse(g, e, 0, o)
    assert rows(seen) == sorted(depth.items(), key=str) and rows(found) == sorted(set(out), key=str)
    assert graph.path_exists(g, e, 0, 0, 0)


def test_paths_equal_a_plain_walk(spark):
    rng = random.Random(5)
    nodes = {k: rng.choice("ab") for k in range(12)}
    edges = [(rng.randrange(12), rng.randrange(12), "x", rng.choice(["fact", "link"])) for _ in range(9)]
    g = graph.nodes(spark.createDataFrame([(k, "t", f"n{k}", d) for k, d in nodes.items()], "id long, type string, name string, domain string"))
    e = spark.createDataFrame(edges, "from_id long, to_id long, relation string, kind string")
    depth, _ = bfs(nodes, edges, 0, graph.Options(2, 1000, follow_links=True))
    assert [graph.path_exists(g, e, 0, k, 2) for k in range(14)] == [k in depth for k in range(14)]
    assert not graph.path_exists(g, e, 77, 0, 2)
    assert rows(graph.traverse(g, e, 0, graph.Options(2, 1, follow_links=True))[0]) == [(0, 0)]


def test_graph_text_and_find(spark):
    ents = spark.createDataFrame([(1, "t", 'A "x"', "d"), (2, "t", "ab", "d"), (3, "t", "xab", "e")], "id long, type string, name string, domain string")
    g = graph.nodes(ents)
    facts = spark.createDataFrame([(1, 2, "p", "approved"), (1, 9, "p", "approved"), (1, 3, "p", "draft"), (None, 2, "p", "approved")], "subject_entity_id long, object_entity_id long, predicate string, status string")
    links = spark.createDataFrame([(2, 3, "same")], "subject_entity_id long, target_entity_id long, relation_type string")
    e = graph.edges(ents, facts, links)
    assert rows(e) == [(1, 2, "p", "fact"), (2, 3, "same", "link")]
    assert [r["line"] for r in graph.to_dot(g, e).collect()] == ["digraph knowledge {", '  1 [label="A \\"x\\""];', '  2 [label="ab"];', '  3 [label="xab"];', '  1 -> 2 [label="p"];', '  2 -> 3 [label="same"];', "}"]
    assert [(r["id"], r["tier"]) for r in graph.find_partial(g, "AB", 5).collect()] == [(2, 0), (3, 2)]
    assert graph.find_exact(g, " AB ", "D").first()["id"] == 2
    with pytest.raises(ValueError, match="empty"):
        graph.find_partial(g, " ", 5)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["alpha platform", "the gates", "course", "ab", "x", "Ash city"]
    names = [(k, "d", rng.choice("uv"), rng.choice(["", "the "]) + "".join(c if rng.random() > 0.06 else rng.choice("abc") for c in rng.choice(base)) + rng.choice(["", "s"])) for k in range(50)]
    label = list(range(50))
    grams = lambda n: {n[i : i + 2] for i in range(len(n) - 1)} or {n}
    for a in range(50):
        for b in range(a):
            x, y = names[a][3], names[b][3]
            near = grams(normalize_py(x)) & grams(normalize_py(y)) and jaro_winkler_py(x, y) >= 0.9
            if names[a][2] == names[b][2] and (near or match_key_py(x) == match_key_py(y) or stem_key_py(x) == stem_key_py(y)):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    df = spark.createDataFrame(names, "id long, domain string, type string, name string")
    got = {r["id"]: (r["cluster"], r["canonical"]) for r in resolve.clusters(df, 0.9).collect()}
    for k in range(50):
        own = [n for n in names if label[n[0]] == label[k]]
        assert got[k] == (label[k], max(own, key=lambda n: (len(n[3]), -n[0]))[3])


def test_tiers_and_replay(spark):
    e = spark.createDataFrame([(1, "t", "City of Ash", "d"), (2, "t", "gate", "d"), (3, "t", "Canon", "d"), (4, "t", "Holder", "d"), (5, "u", "City of Ash", "d")], "id long, type string, name string, domain string")
    m = spark.createDataFrame([(1, "d", "t", "the city of ash"), (2, "d", "t", "gates"), (3, "d", "t", "Nick"), (4, "d", "t", "old holder name"), (5, "d", "t", "city of ashx"), (6, "d", "t", "zzz")], "mention_id long, domain string, type string, name string")
    a = spark.createDataFrame([(4, "Old Holder  Name")], "entity_id long, alias string")
    assert rows(resolve.candidate_tiers(m, e, a, {"nick": "canon"}, 0.9)) == [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (5, 1, 5), (6, None, None)]
    r = spark.createDataFrame([(1, "d", "t", "Ash"), (2, "d", "t", "the ash"), (3, "d", "t", "ashes"), (4, "d", "u", "Ash"), (5, "d", "t", "Nick")], "mention_id long, domain string, type string, name string")
    assert rows(resolve.replay(r, 0.95, {"nick": "Canon"})) == [(1, 1, 0, "the ash"), (2, 1, 1, "the ash"), (3, 1, 2, "the ash"), (4, 4, 0, "Ash"), (5, 5, 0, "Canon")]


def test_merge(spark):
    t = {
        "entities": spark.createDataFrame([(1, "t", "One", "d"), (2, "t", "Two", "d"), (3, "u", "Three", "d")], "id long, type string, name string, domain string"),
        "facts": spark.createDataFrame([(10, 1, "p", 9), (11, 2, "p", 9), (12, 2, "q", 9), (13, 1, "r", 2), (14, 2, "r", 1), (15, 2, "s", None)], "id long, subject_entity_id long, predicate string, object_entity_id long"),
        "chunk_entities": spark.createDataFrame([(5, 1), (5, 2), (6, 2)], "chunk_id long, entity_id long"),
        "entity_sources": spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "entity_id long, document_id long"),
        "entity_links": spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (1, 3, "x")], "subject_entity_id long, target_entity_id long, relation_type string"),
        "entity_aliases": spark.createDataFrame([(2, "deux")], "entity_id long, alias string"),
    }
    out, n = resolve.merge(t, 1, 2)
    assert n == {"facts_dropped": 2, "facts_moved": 3}
    assert rows(out["facts"]) == [(10, 1, "p", 9), (12, 1, "q", 9), (13, 1, "r", 1), (15, 1, "s", None)]
    assert rows(out["chunk_entities"]) == [(5, 1), (6, 1)] and rows(out["entity_sources"]) == [(1, 7), (1, 8)]
    assert rows(out["entity_links"]) == [(1, 3, "x")] and rows(out["entities"], "id") == [(1,), (3,)]
    assert rows(out["entity_aliases"]) == [(1, "deux"), (1, "one"), (1, "two")]
    for into, gone, what in ((1, 9, "exist"), (1, 1, "itself"), (1, 3, "type")):
        with pytest.raises(resolve.MergeError, match=what):
            resolve.merge(t, into, gone)


def test_queue(spark):
    events = spark.createDataFrame([("a", "x", "1", 5, 1, [1]), ("a", "x", "2", 6, 2, [2, 1]), ("b", "x", "3", 1, 3, [])], "type string, identity string, event string, at long, order long, ids array<long>")
    assert rows(maintenance.enqueue(events)) == [("a", "x", "2", [1, 2], "pending", 0, 6), ("b", "x", "3", [], "pending", 0, 1)]
    tasks = spark.createDataFrame([(1, "pending", 0, 0), (2, "pending", 1, 0), (3, "pending", 2, 7)], "id long, status string, attempts int, next_attempt_at long")
    assert rows(maintenance.failed(tasks, 100)) == [(1, "pending", 1, 130), (2, "pending", 2, 160), (3, "error", 3, 7)]


def test_clear_and_collect(spark):
    frame = spark.createDataFrame
    t = {
        "documents": frame([(1,), (2,)], "id long"), "chunks": frame([(10, 1), (20, 2)], "chunk_id long, doc_id long"),
        "chunk_entities": frame([(10, 100), (20, 100), (10, 101)], "chunk_id long, entity_id long"),
        "entities": frame([(100, "t"), (101, "t"), (102, "EntityType"), (103, "t")], "id long, type string"),
        "entity_sources": frame([(100, 1), (100, 2), (101, 1)], "entity_id long, document_id long"),
        "facts": frame([(1000, 100, 101, "approved", 2), (1001, 100, 101, "approved", 1), (1002, 103, None, "draft", 0)], "id long, subject_entity_id long, object_entity_id long, status string, weight long"),
        "fact_sources": frame([(1000, 1), (1000, 2), (1001, 1)], "fact_id long, document_id long"),
        "entity_links": frame([(100, 101)], "subject_entity_id long, target_entity_id long"), "entity_aliases": frame([(101, "a")], "entity_id long, alias string"),
    }
    out = maintenance.clear_document(t, 1)
    assert rows(out["facts"], "id", "weight") == [(1000, 1), (1002, 0)] and rows(out["chunks"]) == [(20, 2)]
    assert rows(out["entities"], "id") == [(100,), (101,), (102,), (103,)] and rows(out["chunk_entities"]) == [(20, 100)]
    swept = maintenance.collect_garbage(out)
    assert rows(swept["facts"], "id") == [(1000,)] and rows(swept["documents"]) == [(2,)] and rows(swept["entities"], "id") == [(100,), (101,), (102,), (103,)]
    assert rows(maintenance.collect_garbage(swept)["entities"], "id") == [(100,), (101,), (102,)]


def test_linkers(spark):
    e = spark.createDataFrame([(1, "t", "Data Lake", "a"), (2, "t", "data  lake", "b"), (3, "t", "one", "a"), (4, "t", "one", "b"), (5, "t", "Москва", "a"), (6, "t", "Moscow", "a")], "id long, type string, name string, domain string")
    assert rows(linking.cross_domain_pairs(e)) == [(1, 2), (3, 4)]
    assert rows(linking.equals_linker(e), "subject_entity_id", "target_entity_id") == [(1, 2), (2, 1)]
    assert (5, 6) in rows(linking.cross_script_pairs(e)) and all(5 in p for p in rows(linking.cross_script_pairs(e)))
    facts = spark.createDataFrame([(1, "p", 9), (2, "q", 8)], "id long, predicate string, other long")
    chunks = spark.createDataFrame([(1, "Deep text")], "id long, text string")
    ready = linking.prepare(e, facts, chunks)
    pairs = linking.cross_domain_pairs(e)
    rule = lambda x: {r["evidence"] for r in linking.rule_linker(pairs, ready, [linking.Rule(i, t, "r", p) for i, t, p in x]).collect()}
    assert rule([("f", "has_fact(a, 'p') && chunk_contains(a, \"Deep\")", 1), ("g", "size(facts(a)) == 0 || false", 2)]) == {"f", "g"}
    assert rule([("n", "!path_exists(a, b) && size(neighbors(a)) + 1 < 2 && a.name.startsWith('D')", 0)]) == {"n"}
    for bad in ("1 + 1", "a.name", "nope(a)", "a.name.rev()", "(a", "a ? b", "1 2"):
        with pytest.raises(linking.RuleError):
            linking.rule_linker(pairs, ready, [linking.Rule("x", bad, "r")])
    answers = spark.createDataFrame([(1, 2, True, 0.96), (3, 4, True, 0.8)], "a long, b long, same_entity boolean, confidence double")
    sources = spark.createDataFrame([(2, 1)], "entity_id long, document_id long")
    assert rows(linking.model_decisions(pairs, answers, e, sources)) == [(1, 2, "link", None), (3, 4, "link", None)]
    assert rows(linking.model_decisions(pairs, answers, e, sources, True)) == [(1, 2, "merge", 2)]
    assert rows(linking.touching(pairs, spark.createDataFrame([(4,)], "x long"))) == [(3, 4)]


def test_extract(spark):
    chunks = spark.createDataFrame([(1, "Код ÄB-1 и äb-1, ÄB-1"), (2, "")], "chunk_id long, search_text string")
    assert rows(extract.by_patterns(chunks, [extract.Pattern("Code", r"\b(\w+-\d)\b"), extract.Pattern("W", r"К\w+")]), "id", "name", "type") == [(1, "ÄB-1", "code"), (1, "äb-1", "code"), (1, "Код", "w")]
    raw = '{"entities": [{"name": "A", "type": "t", "confidence": 7, "description": "' + "x. " * 300 + '", "attributes": {"version": "soon", "k": "v", "g": "Implied by context"}}, {"name": ""}], "relations": [{"subject_type": "t", "subject_name": "A", "predicate": "p", "object_type": "t", "object_name": "B"}, {"predicate": "p"}]}'

    class Stub:
        def answer(self, text, domain):
            return raw

    answers = extract.by_provider(chunks, Stub(), "hr")
    known = answers.filter("id = 1").select("key", "answer")
    assert rows(extract.by_provider(chunks, Stub(), "hr", known)) == rows(answers)
    entities, facts = extract.parsed(answers.filter("id = 1"), "hr")
    got = entities.first()
    assert (got["confidence"], got["metadata"], got["domain"]) == (0.5, '{"k": "v"}', "hr") and len(got["description"]) <= 500 and got["description"].endswith(".")
    assert facts.count() == 1
    kept, left = extract.published(entities, facts, {"hr": 0.4})
    assert kept.count() == 1 and left.count() == 0
    ents = spark.createDataFrame([(1, "t", "A", "hr"), (2, "t", "b", "hr")], "id long, type string, name string, domain string")
    stored = extract.stored_facts(facts.withColumn("doc_id", F.lit(1)).union(facts.withColumn("doc_id", F.lit(2))), ents)
    assert rows(stored) == [(1, "p", 2, 2, "approved")]


def test_quotes(spark):
    cases = [("", "a", "b", ""), ("short", "x", "y", "short"), ("see Ann", "ann", "", "see Ann"), ("k" * 200, "x", "y", "k" * 120 + "..."), ("a" * 70 + "Ann\nmore\n" + "b" * 90, "ann", "b", "a" * 60 + "Ann\nmore...")]
    df = spark.createDataFrame(cases, "t string, s string, o string, want string")
    got = df.select("want", extract.quote(F.col("t"), F.col("s"), F.col("o")).alias("q")).collect()
    assert [r["q"] for r in got] == [r["want"] for r in got]


def test_providers_in_turn_overlay_metadata_and_publish(spark):
    class Fixed:
        def __init__(self, confidence):
            self.confidence = confidence

        def answer(self, text, domain):
            import json

            names = [{"name": w, "type": "t", "confidence": self.confidence, "attributes": {"k": "own", "x": 1}} for w in text.split()]
            return json.dumps({"entities": names, "relations": [{"subject_type": "t", "subject_name": "a", "predicate": "p", "object_type": "t", "object_name": "b"}]})

    from millrace.operators import extract

    chunks = spark.createDataFrame([(1, "a b", '{"k": "chunk"}'), (2, "a", None), (3, "b", "broken")], "chunk_id long, search_text string, metadata string")
    entities, facts = extract.composite(chunks, [("sure", Fixed(0.9)), ("unsure", Fixed(0.2))], "d", metadata_col="metadata")
    got = sorted((r["id"], r["name"], r["metadata"]) for r in entities.collect())
    assert got == [(1, "a", '{"k": "chunk", "x": 1, "provider": "sure"}'), (1, "b", '{"k": "chunk", "x": 1, "provider": "sure"}'), (2, "a", '{"k": "own", "x": 1, "provider": "sure"}'), (3, "b", '{"k": "own", "x": 1, "provider": "sure"}')]
    assert [r["id"] for r in facts.filter("metadata like '%sure%'").collect()].count(1) == 2 and facts.filter("id <> 1").isEmpty()
    none = extract.composite(chunks, [], "d")
    assert none[0].isEmpty() and none[1].isEmpty()


def test_entity_metadata_is_scoped(spark):
    from millrace.operators import extract

    assert extract.scoped_metadata("N", {"URL": 1, "image_paths": [], "space": "s", "title": "T"}) == {"space": "s", "title": "N"}
    assert extract.scoped_metadata("N", {"title": 3, "categories": 1}) == {"title": 3}
    df = spark.createDataFrame([("N", '{"url": "u", "title": "t"}'), ("M", None)], "name string, metadata string")
    assert [r[0] for r in df.select(extract.scoped("name", "metadata")).collect()] == ['{"title": "N"}', "{}"]


def test_embedding_reads_at_most_its_tokens(spark):
    from millrace.operators.providers import MAX_TOKENS, HashEmbedder, embed

    class Words(HashEmbedder):
        def spans(self, text):
            import re

            return [m.span() for m in re.finditer(r"\S+", text)]

    long = " ".join(["a"] * MAX_TOKENS)
    df = spark.createDataFrame([(1, long), (2, long + " b c d")], "chunk_id long, search_text string")
    got = {r["chunk_id"]: list(r["embedding"]) for r in embed(df, Words(8)).collect()}
    assert got[1] == got[2]
    plain = {r["chunk_id"]: list(r["embedding"]) for r in embed(df, HashEmbedder(8)).collect()}
    assert plain[1] != plain[2]


def test_merges_follow_one_another(spark):
    from millrace.operators import linking

    f = spark.createDataFrame
    tables = {
        "entities": f([(1, "t", "Ann", "d"), (2, "t", "Анна", "d"), (3, "t", "Анн", "d")], "id long, type string, name string, domain string"),
        "facts": f([(7, 3, "knows", 9, "approved")], "id long, subject_entity_id long, predicate string, object_entity_id long, status string"),
        "chunk_entities": f([(1, 3)], "chunk_id long, entity_id long"),
        "entity_sources": f([(2, 1)], "entity_id long, document_id long"),
        "entity_links": f([], "subject_entity_id long, target_entity_id long, relation_type string, method string, confidence double"),
        "entity_aliases": f([], "entity_id long, alias string"),
    }
    sure = lambda pairs: pairs.selectExpr("a", "b", "true same_entity", "0.96D confidence")
    links, merges = linking.build_links(tables["entities"], tables["entity_links"], tables["entity_sources"], linking.Linkers(("llm",), answers=sure))
    assert links.isEmpty() and sorted((r["a"], r["b"], r["into"]) for r in merges.collect()) == [(1, 2, 2), (1, 3, 1)]
    out, n = linking.merged(tables, merges)
    assert n == 2 and [r["id"] for r in out["entities"].collect()] == [2]
    assert out["facts"].first()["subject_entity_id"] == 2 and out["chunk_entities"].first()["entity_id"] == 2
    with pytest.raises(ValueError, match="unknown method"):
        linking.build_links(tables["entities"], tables["entity_links"], tables["entity_sources"], linking.Linkers(("guess",)))


def test_numbers_follow_the_order_over_partitions(spark):
    from millrace.runtime import numbered

    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "'x' as place").repartition(7)
    rows = numbered(df, "n", 10, ["k"]).collect()
    assert sorted((r["n"], r["k"]) for r in rows) == [(11 + k, k) for k in range(1000)] and rows[0]["place"] == "x"
    assert numbered(df.limit(0), "n", 0, ["k"]).count() == 0


def test_hot_keys_join_like_others(spark):
    from millrace.operators import skew

    left = spark.range(5000).selectExpr("if(id < 4000, 1, id % 50) k", "id v")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", F.col("k") * 2)
    got = skew.join_spread(left, right, "k", "n")
    assert got.columns == ["k", "v", "w"] and got.count() == 5000 and got.filter("w <> 2 * k").isEmpty()
    assert skew.join_spread(left.withColumn("k", F.when(F.col("v") % 2 == 0, F.col("k"))), right, "k", "n", "left").filter("w is null").count() == 2500


def test_debounced_table_equals_session_windows(spark):
    from millrace.operators.maintenance import debounced

    rows = spark.range(3000).selectExpr("timestamp_seconds(id * 17 + if(id % 40 > 30, id * 11, 0)) ts", "concat('p', id % 5) path").unionAll(spark.sql("select cast(null as timestamp) ts, 'x' path"))
    window = F.session_window("ts", "30 seconds")
    want = rows.filter("ts is not null").groupBy(window).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).selectExpr("session_window.start", "session_window.end", "n", "paths")
    assert sorted(map(tuple, debounced(rows).collect())) == sorted(map(tuple, want.collect()))
    assert debounced(rows.limit(0)).count() == 0


def test_components_with_hubs_dealt_over_tasks(spark, monkeypatch):
    from millrace.operators import components

    monkeypatch.setattr(components, "LIGHT", 0)
    edges = spark.range(1, 3000).selectExpr("if(id < 2000, 0, id - 1) src", "id dst").unionAll(spark.sql("select 9000L, 9001L union all select 9001L, 9002L"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(2000)}, **{k: 0 for k in range(2000, 3000)}, **dict.fromkeys((9000, 9001, 9002), 9000)}
