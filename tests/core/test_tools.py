import numpy as np
import pytest

from millrace.operators import ontology, providers
from millrace.operators.tools import ToolError, Tools


@pytest.fixture(scope="module")
def tools(spark):
    f = spark.createDataFrame
    tables = {
        "documents": f([(1, "p", "t", ["hr"], False, False, 0)], "id long, original_path string, source_type string, domains array<string>, is_official boolean, is_deprecated boolean, updated_at long"),
        "chunks": f([(10, 1, 0, "alpha beta", ["hr"], None, 5), (11, 1, 1, "gamma", ["hr"], 5, 9)], "chunk_id long, doc_id long, seq long, search_text string, domains array<string>, start_offset long, end_offset long"),
        "entities": f([(1, "t", "Ann", "hr"), (2, "t", "Bob", "hr"), (3, "u", "ann", "it")], "id long, type string, name string, domain string"),
        "facts": f([(7, 1, "knows", 2, "approved", "hr"), (8, 2, "knows", 1, "draft", "hr")], "id long, subject_entity_id long, predicate string, object_entity_id long, status string, domain string"),
        "fact_sources": f([(7, 1)], "fact_id long, document_id long"),
        "entity_sources": f([(1, 1)], "entity_id long, document_id long"),
        "entity_links": f([(1, 3, "same", None, 0.9), (3, 1, "same", "m", 0.9)], "subject_entity_id long, target_entity_id long, relation_type string, method string, confidence double"),
        "entity_aliases": f([(1, "annie")], "entity_id long, alias string"),
        "chunk_entities": f([(10, 1)], "chunk_id long, entity_id long"),
        "vectors": f([(10, [1.0]), (11, [3.0])], "chunk_id long, embedding array<float>"),
    }
    return Tools(tables, lambda _: [1.0], 10)


def test_lookups(tools):
    assert tools.entity_id(name=" BOB ") == 2
    for bad in ({}, {"id": 1, "name": "x"}, {"name": "nobody"}, {"name": "ANN"}):
        with pytest.raises(ToolError):
            tools.entity_id(**bad)
    assert tools.get_chunk_by_id(10).first()["start_offset"] == 0
    assert tools.get_fact_by_id(7).first()["documents"] == [1] and tools.get_fact_by_id(8).first()["status"] == "draft"
    assert set(tools.get_document_context(1, facts=True)) == {"document", "chunks", "entities", "facts"}


def test_pages(tools):
    rows, total, cursor = tools.catalog_entities(limit=2)
    assert ([r["id"] for r in rows.collect()], total) == ([1, 2], 3)
    rows, _, cursor = tools.catalog_entities(cursor=cursor)
    assert [r["id"] for r in rows.collect()] == [3] and cursor is None
    assert tools.search_facts()[1] == 1 and tools.search_facts(status="draft", entity="BO")[1] == 1
    assert tools.catalog_documents(domain="hr")[1] == 1 and tools.search_entities_by_type("u")[1] == 1
    assert tools.catalog_overview().count() == 11


def test_search_expands(tools):
    with pytest.warns(UserWarning, match="unknown"):
        tools.search("alpha", domain="none")
    row = tools.search("alpha").first()
    assert row["chunk_id"] == 10 and row["entities"][0]["name"] == "Ann" and len(row["related_entities"][0]["facts"]) == 1


def test_graph_tools(tools):
    nodes, edges = tools.get_entity_relations(1)
    assert sorted(r["id"] for r in nodes.collect()) == [1, 2]
    assert [tuple(r) for r in tools.get_entity_links(1).collect()] == [(3, "same", "m", 0.9)]
    dossier = tools.get_entity_dossier(name="Bob")
    assert dossier["facts"].count() == 1 and dossier["links"].count() == 0
    with pytest.raises(ToolError, match="depth"):
        tools.get_entity_dossier(1, depth=6)


def test_providers(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "chunk_id long, search_text string")
    made = providers.embed(texts, providers.HashEmbedder(8))
    rows = {r["chunk_id"]: r["embedding"] for r in made.collect()}
    assert rows[1] == rows[2] and np.linalg.norm(rows[1]) == pytest.approx(1) and rows[3] == [0.0] * 8

    class Broken(providers.HashEmbedder):
        def embed(self, texts):
            raise RuntimeError

    cache = made.select("key", "embedding").distinct()
    assert providers.embed(texts, Broken(8), cache).count() == 3
    calls, waits = [], []

    def send(request):
        calls.append(request)
        if len(calls) < 3:
            raise providers.ChatError("busy", 503 if len(calls) == 1 else 429)
        return {"choices": [{"message": {"content": "ok"}, "finish_reason": "stop"}]}

    assert providers.chat(send, "m", "s", "u", sleep=waits.append) == "ok" and 0.4 <= waits[0] <= 0.6 and 0.8 <= waits[1] <= 1.2
    for answer in ({"message": {"content": " "}}, {"message": {"content": "x"}, "finish_reason": "length"}):
        with pytest.raises(providers.ChatError):
            providers.chat(lambda r, a=answer: {"choices": [a]}, "m", "s", "u")
    with pytest.raises(providers.ChatError, match="no"):
        providers.chat(lambda r: (_ for _ in ()).throw(providers.ChatError("no", 400)), "m", "s", "u")
    table = providers.put(providers.put(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")
    assert providers.get(table, "k") == "2" and providers.get(table, "x") is None


def test_ontology():
    xml = '<domain auto_publish="0.7"><entities><entity id="e" name="E"><attributes><attribute name="a" type="odd" required="true"/></attributes><synonyms><synonym> s </synonym></synonyms></entity></entities><relations><relation predicate="p" subject="e" object="x"/></relations><rules><rule id="r" type="e" pattern="(" confidence="2"/></rules></domain>'
    own = ontology.load(xml)
    assert own.entities["e"].attributes == (("a", "unknown", True),) and own.entities["e"].synonyms == ("s",) and own.auto_publish == 0.7
    assert len(own.problems()) == 3
    pool = ontology.Ontology({"e": ontology.Entity("e", "pool"), "x": ontology.Entity("x", "X")})
    both = own.effective(pool)
    assert both.entities["e"].name == "E" and "x" in both.entities and len(both.problems()) == 2
    with pytest.raises(ValueError, match="repeated"):
        ontology.load('<d><entity id="e"/><entity id="e"/></d>')
    assert ontology.alias_map({"A": ["a"]}, {"z": {"B": ["b"]}}) == {"a": "A", "b": "B"}
    with pytest.raises(ValueError, match="repeated"):
        ontology.alias_map({"A": ["a"]}, {"z": {"B": ["a"]}})
    assert ontology.section_path("> A\n > B") == "A > B"
    assert ontology.render('{{x}} {{join y "; "}} {{truncate x 2}}', {"x": "abc", "y": [1, 2]}) == "abc 1; 2 ab"
