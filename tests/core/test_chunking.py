import json

import pytest

from millrace.operators import chunking
from millrace.operators.chunking import Chunker
from millrace.sources.html import html_to_markdown_py

TEXT = "intro é\n\n# Top *one*\n\n## Empty\n\n## Näxt\nbody ![a](x.png) 漢\n```\n# not code\n```\n### Deep\n" + "ü" * 25 + "\n# Last\n"


@pytest.mark.parametrize("kind", ["markdown", "mediawiki", "fixed"])
def test_offsets_are_bytes(kind):
    raw = TEXT.encode()
    for c in Chunker(kind, max_chars=10, overlap=3).chunk(TEXT):
        assert raw[c["start"] : c["end"]].decode() == c["text"]


def test_markdown_sections():
    found = Chunker("markdown").chunk(TEXT)
    assert [json.loads(c["metadata"]).get("section_title") for c in found] == [None, "Näxt", "not code", "Deep"]
    assert json.loads(found[1]["metadata"])["image_paths"] == ["x.png"]
    assert found[1]["search_text"].startswith("> Top one\n > Näxt\n\n## Näxt\n")
    assert [c["text"] for c in Chunker("markdown").chunk("no heading " * 300)] == ["no heading " * 300]
    assert Chunker("markdown").chunk(" \n") == []
    with pytest.raises(ValueError, match="strategy"):
        Chunker("other")


def test_wiki_sections():
    text = "lead\n== [[Page|Shown]] ==\nbody\n=== ''Sub'' ===\nmore [[x]]\n== Bare ==\n=bad==\n"
    found = Chunker("mediawiki").chunk(text)
    assert [json.loads(c["metadata"]).get("breadcrumb") for c in found] == [None, "> Shown", "> Shown\n > Sub", "> Bare"]
    assert chunking.unwrap_links("a [[b|c|d]] [[e]] [[f") == "a c|d e [[f"


def test_json_spans():
    text = ' [ {"ti\\u0074le": "é", "n": {"a": "]"}}, 3, {"html": "x\\"y", "z": "q"}, {"n": 1} ] '
    both = Chunker("json").chunk(text)
    assert [c["text"] for c in both] == ['{"ti\\u0074le": "é", "n": {"a": "]"}}', '{"html": "x\\"y", "z": "q"}']
    assert json.loads(both[1]["metadata"]) == {"object_index": 2, "text_fields": ["html"]}
    each = Chunker("json", combine=False).chunk(text)
    assert [(c["text"], json.loads(c["metadata"])["field_name"]) for c in each] == [('"é"', "title"), ('"x\\"y"', "html")]
    assert len(Chunker("json", max_objects=2).chunk(text)) == 1
    assert [c["text"] for c in Chunker("json").chunk('"only"')] == ['"only"']
    for bad in ("{", "[1,]", "NaN", "1 2"):
        with pytest.raises(ValueError):
            Chunker("json").chunk(bad)


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(5, 10, 3, [(0, 5)]), (25, 10, 3, [(0, 10), (7, 17), (14, 24), (21, 25)]), (20, 10, 10, [(0, 10), (10, 20)]), (24, 10, 3, [(0, 10), (7, 17), (14, 24)])])
def test_spans(n, size, overlap, want):
    assert chunking.spans(n, size, overlap) == want


def test_frames_agree(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, " "), (4, "x" * 2500)], "d long, t string")
    want = [(i, c["seq"], c["text"], c["start"], c["end"]) for i, t in ((1, TEXT), (4, "x" * 2500)) for c in Chunker("fixed", 40, 7).chunk(t)]
    assert sorted(tuple(r) for r in chunking.fixed_chunks(df, "d", "t", 40, 7).collect()) == want
    got = chunking.structured_chunks(df, Chunker("fixed", 40, 7), "d", "t").collect()
    assert sorted((r["id"], r["seq"], r["text"], r["start_offset"], r["end_offset"]) for r in got) == want


def test_html():
    html = "<html><head><title>t</title></head><body><h2>A  b</h2><p>x <b>y</b> &amp; <a href='u'>z</a></p><ul><li>1</li><li>2</li></ul><script>no</script><img src=i alt=j></body></html>"
    assert html_to_markdown_py(html) == "## A b\n\nx **y** & [z](u)\n\n- 1\n- 2\n\n![j](i)"
