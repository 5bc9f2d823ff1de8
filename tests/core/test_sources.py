import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sink, synx
from millrace.streaming import queue


@pytest.fixture
def tree(tmp_path):
    def put(name, text):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a.md", "# A\nbody é\n")
    put("c/nested.markdown", "## N\nx\n")
    put("c/pic.PNG", "x")
    put("c/page.md", "md wins")
    put("c/Page.html", "<p>no</p>")
    put("c/only.html", "<h1>T</h1><p>yes</p>")
    put("static/skip.md", "no")
    put("o.json", '{"title": "t"}')
    put("list.json", "[1]")
    put("bad.json", "{")
    return str(tmp_path / "src")


def names(df):
    return sorted(r["source_file"] for r in df.collect())


def test_markdown_and_json(spark, tree):
    assert names(files.markdown(spark, tree)) == ["a.md", "c/nested.markdown", "c/page.md", "static/skip.md"]
    assert names(files.markdown(spark, tree, ["static/", "*.markdown", "# c", ""])) == ["a.md", "c/page.md"]
    good, bad = files.json_files(spark, tree)
    assert sorted(r["metadata"] for r in good.collect()) == ['{"structure":"array"}', '{"structure":"object"}']
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["bad.json"]


@pytest.mark.parametrize(("path", "lines", "out"), [("a/b.md", ["*.md"], True), ("a/b.md", ["*.md", "!b.md"], False), ("a/b.md", ["a/"], True), ("a/b.md", ["/a/*.md"], True), ("x/a/b.md", ["a/b.md"], False), ("a", ["a/"], False)])
def test_ignore(path, lines, out):
    assert files.ignored(path, lines) is out


def test_webpages_and_unstructured(spark, tree):
    pages = {r["source_file"]: r["content"] for r in files.webpages(spark, tree).collect()}
    assert pages == {"a.md": "# A\nbody é\n", "c/page.md": "md wins", "c/only.html": "# T\n\nyes"}
    found = {r["source_file"]: json.loads(r["metadata"]) for r in files.unstructured(spark, tree).collect()}
    assert found["c/page.md"] == {"image_paths": ["pic.PNG"]} and found["a.md"] == {} and found["o.json"] == {"structure": "object"}


def test_mediawiki(spark, tmp_path):
    root = tmp_path / "wiki"
    where = root / "space" / "kind" / "By-Type" / "person"
    where.mkdir(parents=True)
    (root / "graph.json").write_text('{"Ann": ["Bob"]}')
    (where / "ann.json").write_text(json.dumps({"title": "Ann", "wikitext": "", "html": "<p>h</p>", "entity_type": "x", "links": ["L"]}))
    (root / "b.json").write_text(json.dumps({"title": "Bob", "description": "d"}))
    rows = {json.loads(r["metadata"])["title"]: (r["content"], json.loads(r["metadata"])) for r in files.mediawiki(spark, str(root)).collect()}
    assert rows["Ann"] == ("<p>h</p>", {"title": "Ann", "space": "space", "wiki_type": "kind", "entity_type": "person", "page_links": ["L"], "graph_relations": ["Bob"]})
    assert rows["Bob"] == ("Bob\n\nd", {"title": "Bob", "entity_type": ""})


def test_registry_and_chunks(spark, tree):
    registry = files.Registry()
    with pytest.raises(ValueError, match="already"):
        registry.register("json", files.markdown)
    with pytest.raises(ValueError, match="unknown"):
        registry.get("none")
    assert registry.get("", "x/wiki/y") is files.mediawiki and files.detect_type("a") == "unstructured"
    docs = files.with_domains(files.markdown(spark, tree), ["hr"])
    rows = {r["text"]: json.loads(r["metadata"]) for r in files.chunked(docs).collect()}
    assert rows["# A\nbody é\n"] == {"domain": ["hr"], "section_title": "A", "heading_level": 1, "breadcrumb": "> A"}
    known = files.markdown(spark, tree).filter("source_file = 'a.md'").select("path", F.sha2("content", 256).alias("content_hash"))
    assert "a.md" not in names(files.changed(docs, known))


def test_synx(spark, tmp_path):
    ids, v = np.array([5, 1, 3]), np.arange(6, dtype=np.float32).reshape(3, 2)
    data = synx.pack(ids, v)
    assert len(data) == 20 + 3 * 12 and synx.unpack(data)[0].tolist() == [1, 3, 5]
    for bad in (b"NOPE" + data[4:], data[:4] + b"\x02" + data[5:], data[:-1], data[:10]):
        with pytest.raises(ValueError):
            synx.unpack(bad)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "chunk_id long, embedding array<float>")
    synx.write(df, str(tmp_path / "out"), 2)
    assert sorted(map(tuple, synx.read(spark, str(tmp_path / "out")).collect())) == sorted((r["chunk_id"], r["embedding"]) for r in df.collect())


def test_store(spark, tmp_path):
    store = sink.Store(spark, str(tmp_path / "kb"))
    assert store.commit({"a": spark.range(3), "b": spark.range(1)}) == 1 and store.commit({"a": spark.range(5)}) == 2
    assert store.read("a").count() == 5 and store.read("a", 1).count() == 3 and store.read("b").count() == 1
    assert store.prune(1) == 1 and store.versions() == [2] and store.read("b").count() == 1


def test_streams(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    rows = spark.createDataFrame([("doc:index", "a", "e1", 5), ("doc:index", "a", "e2", 7), ("doc:index", "b", "e3", 6)], queue.TASK.replace("status string, attempts int, next_attempt_at", "at"))
    rows.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    queue.worker(queue.tasks(stream), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [("doc:index", "a", "e2", "pending", 0, 7), ("doc:index", "b", "e3", "pending", 0, 6)]
