"""Near-duplicate documents by SimHash, compared over vertically stored bit planes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.operators.skew import join_spread
from millrace.runtime import bound_batches, discard, fresh, materialize, releasing

SEED = 42
#: A bucket is to hold about this many unrelated fingerprints at most.
CROWD = 64
#: Buckets above this many fingerprints are compared as pairs of slices, each pair a task of its own.
SLICE = 16384
#: Buckets up to this size are compared many at a time.
SMALL = 128
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes, words: int, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles of a UTF-8 text; A-Z are lower-cased, words end at ASCII space."""
    found = raw.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    total, counts = len(found) - words + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, 65536):
        part = found[at : at + 65536 + words - 1]
        hashes = np.array([digest(join(s), seed) for s in zip(*(part[k:] for k in range(words)), strict=False)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = SEED) -> DataFrame:
    """(id, fingerprint bigint) for each row of docs; a null text has no words and so fingerprint 0."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            marks = np.array([fingerprint(t.as_py() or b"", words, seed) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(run), f"id {kind}, fingerprint bigint")


def bit_planes(marks: np.ndarray) -> np.ndarray:
    """64 rows of uint64 words: word w of plane p holds bit p of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(marks) // 64) * 64, "<u8")
    padded[: len(marks)] = marks
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare query k with the 64 fingerprints of word words[k], all k at once.

    Distances are counted for 64 lanes in carry-save counters that start at 2^b - 1 - radius: the carry out of the top
    bit marks a lane whose distance exceeds the radius. Words all of whose lanes are marked are given up every 8
    planes. Returns the indexes k that are left and the lanes within the radius.
    """
    at, width = np.arange(len(queries)), max(1, int(radius).bit_length())
    start, over = (1 << width) - 1 - radius, ~alive
    counters = [np.full(len(at), _FULL if start >> b & 1 else 0, "<u8") for b in range(width)]
    for plane in range(64):
        carry = planes[plane][words] ^ (np.uint64(0) - ((queries >> np.uint64(plane)) & np.uint64(1)))
        for b in range(width):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if plane % 8 == 7:
            keep = over != _FULL
            if not keep.all():
                at, queries, words, over = at[keep], queries[keep], words[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(at):
                break
    return at, ~over


def _expand(rows: np.ndarray, words: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(bits)
    return rows[k], words[k] * 64 + lane


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 under links a-b, the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def link_sorted(groups: np.ndarray, marks: np.ndarray, radius: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each run of equal groups, all fingerprints that lie within the radius of one another."""
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    start, size = edge[:-1], np.diff(edge)
    out_a, out_b = [], []
    few = (size > 1) & (size <= small)
    picked = np.repeat(few, size)
    if picked.any():
        own, size_few = marks[picked], size[few]
        stop = np.repeat(np.cumsum(size_few), size_few)
        row = np.arange(len(own))
        spans = (stop - 1) // 64 - row // 64 + 1
        query = np.repeat(row, spans)
        word = query // 64 + np.arange(len(query)) - np.repeat(np.cumsum(spans) - spans, spans)
        low = np.clip(query + 1 - word * 64, 0, 64).astype("<u8")
        high = np.clip(stop[query] - word * 64, 0, 64).astype("<u8")
        below = lambda x: np.where(x >= 64, _FULL, (np.uint64(1) << np.minimum(x, np.uint64(63))) - np.uint64(1))
        alive = below(high) & ~below(low)
        use = alive != 0
        query, word, alive = query[use], word[use], alive[use]
        k, lanes = lanes_within(bit_planes(own), own[query], word, alive, radius)
        a, b = _expand(query[k], word[k], lanes)
        label = least_labels(len(own), a, b)
        moved = np.flatnonzero(label != np.arange(len(own)))
        out_a.append(own[moved])
        out_b.append(own[label[moved]])
    for s, n in zip(start[size > small], size[size > small], strict=True):
        a, b = _sweep(marks[s : s + n], radius)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, "<u8")
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _sweep(marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large bucket: what a query reaches leaves the planes' live lanes at once, so a dense
    group of near copies costs one pass over its outsiders for each member and never all its pairs."""
    marks = np.unique(marks)
    n, planes = len(marks), bit_planes(marks)
    live = np.full(planes.shape[1], _FULL, "<u8")
    if n % 64:
        live[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    out_a, out_b, next_seed, queue = [], [], 0, np.zeros(0, np.int64)
    clear = lambda rows: np.bitwise_and.at(live, rows // 64, ~(np.uint64(1) << (rows % 64).astype("<u8")))
    while True:
        if not len(queue):
            open_words = np.flatnonzero(live[next_seed:])
            if not len(open_words):
                break
            next_seed += int(open_words[0])
            word = int(live[next_seed])
            queue = np.array([next_seed * 64 + (word & -word).bit_length() - 1])
            clear(queue)
        words = np.flatnonzero(live)
        if not len(words):
            break
        take = max(1, min(len(queue), 65536 // len(words)))
        now, queue = queue[:take], queue[take:]
        query, word = np.repeat(now, len(words)), np.tile(words, take)
        k, lanes = lanes_within(planes, marks[query], word, live[word], radius)
        a, b = _expand(query[k], word[k], lanes)
        b, first = np.unique(b, return_index=True)
        if len(b):
            out_a.append(marks[b])
            out_b.append(marks[a[first]])
            clear(b)
            queue = np.concatenate([queue, b])
    none = np.zeros(0, "<u8")
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def piece_keys(column: str, radius: int, pieces: int) -> list:
    """bigint columns, one for each choice of pieces - radius pieces: number of the choice, then the pieces' bits."""
    cut = [64 * k // pieces for k in range(pieces + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        key = F.lit(number).cast("bigint")
        for p in chosen:
            width = cut[p + 1] - cut[p]
            bits = F.shiftrightunsigned(F.col(column), cut[p]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        out.append(key)
    return out


def pieces_for(count: int, radius: int) -> int:
    """The fewest pieces, radius + 2 at least, whose keys spread `count` fingerprints over buckets of about CROWD.

    More pieces mean longer keys and more of them; each number finds the same pairs.
    """
    pieces = radius + 2
    while pieces < 16 and 64 * (pieces - radius) // pieces < math.log2(max(count, 1) / CROWD):
        pieces += 1
    return pieces


def links(marks: DataFrame, radius: int = 4, pieces: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """(src, dst): enough links between distinct fingerprints to connect all that differ in `radius` bits or fewer.

    Two fingerprints within the radius agree on pieces - radius whole pieces, so each meets every partner in a bucket;
    by default their number follows that of the rows. A bucket above slice_rows is split into slices, and each pair of
    slices is a task: no task holds more than two.
    """
    spark = marks.sparkSession
    bound_batches(spark)
    pieces = pieces or pieces_for(marks.count(), radius)
    keyed = marks.select("fingerprint").distinct().select(F.explode(F.array(*piece_keys("fingerprint", radius, pieces))).alias("key"), "fingerprint")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows).select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("m"))
    dealt = keyed.join(large, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.expr("cast(pmod(xxhash64(fingerprint), m) as int)")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
    tasks = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
    ordered = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 65536:
                yield from work(held, False)
        yield from work(held, True)

    def work(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Link all whole groups of the rows held; the last group may go on, so its rows stay."""
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        key, i, j = (whole.column(c).to_numpy() for c in range(3))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        end = whole.num_rows if last else int(np.flatnonzero(new)[-1])
        held[:] = [] if end == whole.num_rows else whole.slice(end).to_batches()
        if end:
            a, b = link_sorted(np.cumsum(new[:end]), whole.column(3).to_numpy()[:end].view("<u8"), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["src", "dst"])

    return ordered.mapInArrow(releasing(run), "src bigint, dst bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, pieces: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    component_id is the least non-null id among the rows whose fingerprints are connected by steps of `radius` bits or
    fewer. Texts without words (null, empty, blank) share fingerprint 0 and link like any other. A row is told by its
    fingerprint: repeated rows get the same class each, equal ids with different texts keep a class for each text, a
    null id is never a class's least while another exists. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    near = materialize(links(rows, radius, pieces, slice_rows), "links")
    roots = connected_components(near).select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    discard(near)
    classed = least.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    classes = classed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_spread(classed, classes, "root", "members").select("fingerprint", "component_id", "n")
    return join_spread(rows, named, "fingerprint", "n").select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: the least id, then the least text hash.

    Nulls in id_col come last. Rows alike in id and text are one document, of which one row stays.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    rows = docs.select(key.alias("key"), text.alias("text"))
    classes = materialize(near_duplicates(rows, "key", "text", words, radius), "classes").filter(F.col("id") == F.col("component_id"))
    chosen = classes.groupBy("id").agg(F.count("*").alias("n"))
    repeated = bool(chosen.filter("n > 1").limit(1).count())
    name = fresh(docs.columns, "key")
    kept = docs.join(chosen.select(F.col("id").alias(name)), key == F.col(name), "left_semi")
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
