"""Token counts by a two-tier lookup of pre-token lengths, inside the map tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches, releasing

#: Entries of the broadcast table of frequent pre-tokens: its proven bound.
TABLE = 32768
#: Counters kept by a task's frequency sketch, and rows merged into one sketch at a time.
SKETCH, FAN_IN = 8192, 64
#: Entries and characters of a worker's cache of rarer pre-tokens, which starts anew when either is full; longer
#: pre-tokens are not counted as frequent.
CACHE, CACHE_CHARS, LONGEST = 400_000, 16 << 20, 64

# The special strings and the split pattern of the vocabulary file word_bpe_49k.json, the pattern
# written for texts of ASCII and Latin-1 letters.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")

#: Before a pre-token in mapped bytes: no pre-token holds it, as a blank.
MAPPED = " "

_PLAIN = re.compile(r"[\x00-\x7FÀ-ÿ]*\Z")
_tables: dict[str, dict[str, int]] = {}
_tokenizers: dict[str, object] = {}


def load(text: str):
    """The library's tokenizer from a file's text, without truncation or padding; kept for the worker's life."""
    from tokenizers import Tokenizer

    if (found := _tokenizers.get(text)) is None:
        found = Tokenizer.from_str(text)
        found.no_truncation()
        found.no_padding()
        _tokenizers.clear()
        _tokenizers[text] = found
    return found


def lengths(tokenizer, words: list[str]) -> list[int]:
    """Tokens of each word, as words_of gives them, by the library; this process's threads are left to Spark."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    plain = [w for w in words if not w.startswith(MAPPED)]
    known = iter([len(e.ids) for at in range(0, len(plain), 4096) for e in encode(plain[at : at + 4096], add_special_tokens=False)])
    return [len(tokenizer.model.tokenize(w[1:])) if w.startswith(MAPPED) else next(known) for w in words]


def words_of(tokenizer, text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and the special strings between them.

    A text of ASCII and Latin-1 letters is cut by PRE_TOKEN; any other by the library's own normalizer and
    pre-tokenizer, whose pre-tokens are written in mapped bytes: those that are not plain ASCII get the mark MAPPED.
    """
    parts = SPECIAL.split(text) if "<|" in text else [text]
    if _PLAIN.match(text):
        return (PRE_TOKEN.findall(text.lower()) if len(parts) == 1 else [w for part in parts for w in PRE_TOKEN.findall(part.lower())]), len(parts) - 1
    cut, normal = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.normalizer.normalize_str
    return [w if w.isascii() else MAPPED + w for part in parts for w, _ in cut(normal(part))], len(parts) - 1


class Sketch:
    """Frequent items by Misra-Gries: counts are low by at most total / size, and items above that are kept."""

    def __init__(self, size: int = SKETCH):
        self.size, self.counts = size, Counter()

    def add(self, items: Iterable[str] | Counter) -> None:
        self.counts.update(items)
        if len(self.counts) > 16 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            cut = int(np.partition(np.fromiter(self.counts.values(), np.int64), -self.size - 1)[-self.size - 1])
            self.counts = Counter({k: v - cut for k, v in self.counts.items() if v > cut})

    def batch(self) -> pa.RecordBatch:
        self.shrink()
        counts = np.fromiter(self.counts.values(), "<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(["\n".join(self.counts)]), pa.array([counts], pa.binary())], names=["items", "counts"])

    def merge(self, items: str, counts: bytes) -> None:
        self.add(Counter(dict(zip(items.split("\n"), np.frombuffer(counts, "<i8").tolist(), strict=True))) if items else Counter())


def frequent(texts: DataFrame, model, size: int = SKETCH) -> list[str]:
    """The most frequent pre-tokens of all texts, at most TABLE, from sketches merged FAN_IN at a time; model is the
    broadcast text of the tokenizer's file.

    What moves is one sketch for each task, never pre-tokens; the driver gets FAN_IN sketches at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, tokenizer = Sketch(size), load(model.value)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    sketch.add(w for w in words_of(tokenizer, text)[0] if len(w) <= LONGEST)
        yield sketch.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(size)
        for batch in batches:
            for items, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sketch.merge(items, counts)
        yield sketch.batch()

    schema = "items string, counts binary"
    sketches, parts = texts.mapInArrow(releasing(count), schema), texts.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sketches = sketches.repartition(parts).mapInArrow(releasing(merge), schema)
    total = Sketch(TABLE)
    for row in sketches.collect():
        total.merge(row["items"], bytes(row["counts"]))
    return [w for w, _ in total.counts.most_common(TABLE)]


class Lengths:
    """Token counts of texts from the broadcast table, then the worker's cache, then the library."""

    def __init__(self, tokenizer, table: dict[str, int]):
        self.tokenizer, self.table, self.cache, self.chars = tokenizer, table, dict(table), 0

    def learn(self, words: set[str]) -> None:
        new = list(words)
        if len(self.cache) + len(new) > CACHE + len(self.table) or self.chars > CACHE_CHARS:
            self.cache, self.chars = dict(self.table), 0
        self.chars += sum(map(len, new))
        self.cache.update(zip(new, lengths(self.tokenizer, new), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out, kept, missing = [0] * len(texts), [], set()
        for k, text in enumerate(texts):
            if not text:
                continue
            words, out[k] = words_of(self.tokenizer, text)
            kept.append((k, words))
            missing.update(words)
            if len(missing) > CACHE // 4:
                self._settle(out, kept, missing)
        self._settle(out, kept, missing)
        return out

    def _settle(self, out: list[int], kept: list, missing: set[str]) -> None:
        new = missing.difference(self.cache)
        if new:
            self.learn(new)
            if missing - self.cache.keys():  # the cache began anew
                self.learn(missing.difference(self.cache))
        for k, words in kept:
            out[k] += sum(map(self.cache.__getitem__, words))
        kept.clear()
        missing.clear()


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs, as the library counts without added special tokens.

    Texts are cut into pre-tokens, whose lengths add up, as merges never cross pre-tokens: frequent ones come from the
    broadcast table, others from the worker's cache or, at first, the library. A null or empty text has 0 bytes and tokens. Rows are
    independent, repeated ids and null ids pass through, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = Path(tokenizer_file).read_text(encoding="utf-8")
    model = spark.sparkContext.broadcast(source)
    words = frequent(rows.select("text"), model)
    known = lengths(load(source), words)
    table = spark.sparkContext.broadcast(("\n".join(words), np.array(known, "<u2").tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, packed = table.value
        counter = Lengths(load(model.value), dict(zip(joined.split("\n"), np.frombuffer(packed, "<u2").tolist(), strict=True)) if joined else {})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.count(batch.column(2).to_pylist()), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    counted = rows.select("id", size, "text").mapInArrow(releasing(run), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
