import json
import re

import pytest

from millrace.operators.extract import Pattern
from millrace.operators.providers import HashEmbedder
from millrace.plans import ingest
from millrace.sources import files, synthetic
from millrace.sources.sink import Store


def test_cycle(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\nwith Ann Lee and AB-1.\n")
    (src / "b.md").write_text("# B\nonly AB-1 and ab-1.\n")
    store, patterns = Store(spark, str(tmp_path / "kb")), [Pattern("Code", r"\b[A-Za-z]+-\d\b"), Pattern("Person", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")]
    settings = ingest.Settings(patterns, embedder=HashEmbedder(8))
    run = lambda: ingest.work(store, files.markdown(spark, str(src)), settings)
    rows = lambda n, *c: sorted(tuple(r) for r in store.read(n).select(*c).collect())
    assert run() == {"indexed": 2, "deleted": 0} and run() == {"indexed": 0, "deleted": 0}
    assert rows("entities", "type", "name") == [("code", "AB-1"), ("person", "Ann Lee")]
    assert rows("chunk_entities", "chunk_id", "entity_id").count((1, 1)) == 1 and store.read("vectors").count() == 2
    (src / "a.md").write_text("# A\nnothing\n")
    assert run() == {"indexed": 1, "deleted": 0}
    assert rows("entities", "name") == [("AB-1",)] and store.read("vectors").count() == 2
    (src / "b.md").unlink()
    assert run() == {"indexed": 0, "deleted": 1}
    assert rows("documents", "path")[0][0].endswith("a.md") and store.read("entities").count() == 0


def test_synthetic_is_reproducible(spark):
    a, b = synthetic.generate(spark, "tiny", 1), synthetic.generate(spark, "tiny", 1)
    assert all(sorted(map(tuple, a[n].collect()), key=str) == sorted(map(tuple, b[n].collect()), key=str) for n in a)
    assert a["facts"].filter("status = 'approved'").count() > 300 and a["chunks"].count() == 1000


def test_worker_takes_tasks_from_the_queue(spark, tmp_path):
    class Reader:
        """Names after "Person" and who works with whom, as a model would answer."""

        def answer(self, text, domain):
            names = re.findall(r"[A-Z][a-z]+ [A-Z][a-z]+", text)
            pairs = [(m[1], m[2]) for m in re.finditer(r"([A-Z][a-z]+ [A-Z][a-z]+) works with ([A-Z][a-z]+ [A-Z][a-z]+)", text)]
            return json.dumps({"entities": [{"name": n, "type": "Person", "confidence": 0.5 if n.startswith("Maybe") else 0.9} for n in names], "relations": [{"subject_type": "Person", "subject_name": a, "predicate": "works_with", "object_type": "Person", "object_name": b} for a, b in pairs]})

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\nAnn Lee works with Bob Ray\n")
    (src / "b.md").write_text("# B\nAnn Leee works with Bob Ray\n\nMaybe Not works with Bob Ray\n")
    (src / "c.md").write_text("# C\nEva Moe works with Ann Lee\n")
    store = Store(spark, str(tmp_path / "kb"))
    settings = ingest.Settings([], [("reader", Reader())], "people", resolving=True)
    disk = files.markdown(spark, str(src))
    paths = sorted(r["path"] for r in disk.select("path").collect())
    events = spark.createDataFrame([("doc:index", paths[0], "", 5), ("doc:index", paths[1], "", 6), ("doc:index", "/gone.md", "", 7), ("doc:index", paths[2], "", 99), ("odd", "x", "", 1)], "type string, identity string, event string, at long")
    ingest.enqueue(store, events)
    with pytest.warns(UserWarning, match="gone"):
        assert ingest.run_once(store, disk, settings, 10) == {"done": 2, "failed": 1, "unknown": 1}
    queue = lambda: {(r["type"], r["identity"]): (r["status"], r["attempts"], r["next_attempt_at"]) for r in store.read("queue").collect()}
    assert queue()["doc:index", "/gone.md"] == ("pending", 1, 40) and queue()["doc:index", paths[0]][0] == "done"
    assert queue()["doc:index", paths[2]] == ("pending", 0, 99) and queue()["odd", "x"][0] == "processing"
    assert {k for k in queue() if k[0] == "entity:link"} == {("entity:link", "1"), ("entity:link", "2")}
    names = sorted(r["name"] for r in store.read("entities").collect())
    assert names == ["Ann Leee", "Bob Ray"]
    assert [(r["weight"], r["status"]) for r in store.read("facts").collect()] == [(2, "approved")]
    assert ingest.run_once(store, disk, settings, 10) == {"done": 2, "failed": 0, "unknown": 0}
    ingest.enqueue(store, spark.createDataFrame([("doc:delete", p, "", 0) for p in paths], "type string, identity string, event string, at long"))
    ingest.run_once(store, disk, settings, 20)
    assert store.read("documents").count() == 0 and store.read("entities").count() == 0 and not any(k[0] == "doc:delete" for k in queue())


def test_fill_replaces_tables_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    chunks = spark.createDataFrame([(1, 1, 0, "a b a", "a b a", 0, 5, "{}")], ingest.EMPTY["chunks"])
    assert ingest.fill(store, {"chunks": chunks}, HashEmbedder(4)) == 1
    assert sorted(tuple(r) for r in store.read("postings").collect()) == [("a", 1, 2), ("b", 1, 1)] and store.read("vectors").count() == 1
