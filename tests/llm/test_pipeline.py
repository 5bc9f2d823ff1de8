import hashlib
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from millrace.llm import pieces, simhash

MODEL = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")


def test_stages_follow_one_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        kept.append(docs.count())
        assert docs.columns == (columns if k < 4 else [*columns, "ids", "decoded_sha256", "round_trip"]), name
        if name == "private data":
            assert kept[-1] == kept[-2] and not any(re.search(r"@mail\d", r["text"]) for r in docs.collect())
        if name == "near-duplicates":
            again = simhash.near_duplicates(docs, words=4).collect()
            assert all(r["id"] == r["component_id"] for r in again)
    codec = pieces.Codec(pieces.Vocabulary.read(MODEL))
    for r in docs.limit(20).collect():
        assert r["ids"] == pieces.np.frombuffer(codec.encode(r["text"]), "<i4").tolist()
    assert kept[1] > 0.95 * kept[0]


def test_one_row_of_a_document_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words here now"), (2, None), (5, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    got = simhash.keep_one(df, words=4)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == [(1, "a b c d e"), (2, None), (None, "other words here now")]


def test_the_pipeline_decodes_what_it_encodes(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == [*spark.read.parquet(f"{sf}/documents.parquet").columns, "ids", "decoded_sha256", "round_trip"]
    codec = pieces.Codec(pieces.Vocabulary.read(MODEL))
    got = rows.collect()
    assert got and all(r["round_trip"] for r in got)
    for r in got:
        back = codec.decode(pieces.np.array(r["ids"], "<i4").tobytes())
        assert back == (r["text"] or "").replace(pieces.SPACE, " ") and r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("extra", [{}, {"n_chars": None}])
def test_odd_tables(spark, tmp_path, extra):
    """Nulls in every column, empty and long texts, copies, repeated rows, and columns by the names that stages use."""
    words = [" ".join(f"w{chr(97 + (k * j) % 26)}{chr(97 + j % 26)}" for j in range(1, 60)) for k in range(12)]
    texts = [None, "", " \n", words[0], words[0], *words[1:], "long " * 60_000, "mail joe.x1@host.example and joe.x1"]
    rows = [(k if k != 7 else None, t, None if k == 3 else "aa", None if k == 5 else f"s{k % 3}", "ids", 1, "key", 2) for k, t in enumerate(texts)] * 2
    schema = "doc_id long, text string, lang string, source string, ids string, size int, key string, n int"
    spark.createDataFrame([(*r, *extra.values()) for r in rows], schema + "".join(f", {c} long" for c in extra)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["round_trip"] for r in got) and not any("@" in r["text"] for r in got)
    assert {r["text"] for r in got} <= {pii_masked(t) for t in texts if t and t.strip()}
    if extra:
        assert all(r["n_chars"] == len(r["text"]) for r in got)


def pii_masked(text):
    return text.replace("joe.x1@host.example", "<EMAIL>").replace("joe.x1", "<EMAIL>")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
