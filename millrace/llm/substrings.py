"""Substring dedup: recurring passages are confirmed, compiled into sharded automata, and located in every document."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches, discard, materialize, releasing

WINDOW = 20
#: Bits of the filter of recurring anchors, 32 MB: its proven bound. A fuller filter passes more segments, never fewer.
FILTER_BITS = 28
#: An anchor with more than one in so many of all anchors, and more than HOT_LEAST, is dealt over SALTS tasks first; so
#: at most HOT_SHARE anchors are, 8 MB.
HOT_SHARE, HOT_LEAST, SALTS = 1_000_000, 2_000, 64
#: Text bytes of an Arrow batch and of a block that is hashed at once, characters of one automaton's passages, rows
#: and characters of one group that are located at a time, and windows of a segment.
BATCH_BYTES, BLOCK_BYTES, SHARD_CHARS, PART_ROWS, PART_CHARS, SEGMENT = 4 << 20, 1 << 20, 1 << 20, 20_000, 8 << 20, 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of the bytes; words also end at the offsets in breaks."""
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    first[at] |= ~blank[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    last = ~blank
    last[:-1] &= blank[1:]
    last[at - 1] |= ~blank[at - 1]
    ends = np.flatnonzero(last) + 1
    hashes, k = np.zeros(len(starts), np.uint64), 0
    powers = np.cumprod(np.full(max(64, int((ends - starts).max())), _ODD, np.uint64))
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(starts, starts[k] + BLOCK_BYTES)))
        low, own = starts[k], starts[k:j] - starts[k]
        part = data[low : ends[j - 1]]
        place = np.arange(len(part)) - np.repeat(own, np.diff(np.append(own, len(part))))
        values = np.where(blank[low : ends[j - 1]], np.uint64(0), (part.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)])
        hashes[k:j] = np.add.reduceat(values, own)
        k = j
    return starts, ends, _mix(hashes ^ ((ends - starts).astype(np.uint64) * _ODD))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i that has so many."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors_of(hashes: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words with hashes and document numbers: the windows' anchors, which windows lie in one document, and the
    hashes at all anchor places.

    A window's anchor is the least hash of its runs of gram words, so equal windows have equal anchors. A place counts
    if its run is the anchor of any window over it.
    """
    gram = max(1, 2 * window // 5)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    runs = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        runs = runs * _ODD + hashes[k : len(hashes) - gram + 1 + k]
    runs = _mix(runs) | np.uint64(1)
    span = window - gram + 1
    anchor = _sliding(runs, span, np.minimum)
    inside = doc[: len(anchor)] == doc[window - 1 :]
    over = np.zeros(len(runs) + span - 1, np.uint64)
    over[span - 1 : span - 1 + len(anchor)] = np.where(inside, anchor, np.uint64(0))
    return anchor, inside, runs[_sliding(over, span, np.maximum) == runs]


class Batch:
    """Words of an Arrow column of texts, and their windows."""

    def __init__(self, column: pa.Array, window: int):
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        self.raw = memoryview(whole)[offsets[0] : offsets[-1]] if whole is not None and len(offsets) else memoryview(b"")
        breaks = (offsets - offsets[0]).astype(np.int64)
        self.starts, self.ends, hashes = word_table(np.frombuffer(self.raw, np.uint8), breaks)
        self.doc = np.searchsorted(breaks, self.starts, side="right") - 1
        self.first_word = np.searchsorted(self.starts, breaks[:-1])
        self.anchor, self.inside, self.places = anchors_of(hashes, self.doc, window)

    def words(self, a: int, b: int) -> bytes:
        return b" ".join(bytes(self.raw[self.starts[a] : self.ends[b - 1]]).split())


def anchor_counts(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ah, n): how many places each anchor has, in all texts. Counts combine in each batch and before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(Batch(batch.column(0), window).places, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("<i8")), pa.array(n.astype("<i8"))], names=["ah", "n"])

    return texts.mapInArrow(releasing(run), "ah bigint, n bigint").groupBy("ah").agg(F.sum("n").alias("n"))


def recurring_filter(counts: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2^bits bits (2^15 at least) over the high bits of the anchors found twice or more, built by the executors in pieces."""
    slot = F.shiftrightunsigned("ah", 64 - bits) + 1  # the functions count buckets and places of positive numbers from 1
    pieces = counts.filter("n > 1").groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b"))
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for row in pieces.toLocalIterator():
        at = (row["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["b"], np.uint8)
    return out


def passes(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    slot = anchors >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def segments(rows: DataFrame, bitmap, hot, window: int = WINDOW, salts: int = SALTS) -> DataFrame:
    """(ah, salt, did, th, start, n, words): runs of up to SEGMENT windows under one anchor that the filter passes, with
    their words. Rows of a hot anchor are dealt over salts by document, so that copies of a text part as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        for batch in batches:
            found = Batch(batch.column(2), window)
            use = found.inside.copy()
            use[use] = passes(bitmap.value, found.anchor[use])
            at = np.flatnonzero(use)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (found.anchor[at[1:]] != found.anchor[at[:-1]]) | (found.doc[at[1:]] != found.doc[at[:-1]])
            run = np.flatnonzero(new)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            new |= place % SEGMENT == 0
            begin = at[new]
            n = np.diff(np.append(np.flatnonzero(new), len(at)))
            ah, doc = found.anchor[begin].view("<i8"), found.doc[begin]
            where = np.minimum(np.searchsorted(often, ah), max(0, len(often) - 1))
            common = often[where] == ah if len(often) else np.zeros(len(ah), bool)
            th = batch.column(1).to_numpy()[doc]
            salt = common.astype("<i4")
            words = [found.words(b, b + k + window - 1) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
            arrays = [pa.array(ah), pa.array(salt), batch.column(0).take(pa.array(doc)), pa.array(th), pa.array(begin - found.first_word[doc]), pa.array(n.astype("<i4")), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["ah", "salt", "did", "th", "start", "n", "words"])

    kind = rows.schema["did"].dataType.simpleString()
    found = rows.mapInArrow(releasing(run), f"ah bigint, salt int, did {kind}, th bigint, start bigint, n int, words binary")
    return found.withColumn("salt", F.when(F.col("salt") > 0, F.pmod(F.xxhash64("did", "th"), F.lit(salts)).cast("int") + 1).otherwise(0))


Row = tuple[int, object, int, int, int, str]  # salt, did, th, start, n, words


def windows_of(words: str, n: int, window: int) -> list[str]:
    found = words.split(" ")
    return [" ".join(found[k : k + window]) for k in range(n)]


def confirm(group: list[Row], known: set[str], window: int) -> list[tuple[str, int]]:
    """(passage, windows in it) that recur in a group of segments, or recur from what is known of it already.

    A group whose segments are all alike, without a window twice in one, is one passage; else passages are windows.
    """
    texts = Counter((r[5], r[4]) for r in group)
    if len(texts) == 1 and not known:
        (words, n), times = next(iter(texts.items()))
        if n == 1 or len(set(windows_of(words, n, window))) == n:
            return [(words, n)] if times > 1 else []
    counts: Counter = Counter()
    for (words, n), times in texts.items():
        for w in windows_of(words, n, window):
            counts[w] += times
    return [(w, 1) for w, c in counts.items() if c > 1 or w in known]


def locate(groups: list[list[Row]], passages: list[list[tuple[str, int]]], known: set[str]) -> Iterator[tuple[Row, list[tuple[int, int]]]]:
    """Each segment with the runs (offset, windows) of it that also start earlier.

    The passages are compiled into automata of bounded size and every segment of the groups is streamed through them.
    Segments come in order of document and place, so a passage's first hit is its first occurrence; a hit at the very
    same place is a repeated row, not a later occurrence. Groups of one anchor and different salts may share passages,
    so first hits are kept for each group.
    """
    import ahocorasick

    todo = [k for k, p in enumerate(passages) if p]
    removed: dict[tuple[int, int], list[tuple[int, int]]] = {}
    queue = [(k, words, n) for k in todo for words, n in passages[k]]
    at = 0
    while at < len(queue):
        machine, size, scanned = ahocorasick.Automaton(), 0, set()
        while at < len(queue) and (size == 0 or size + len(queue[at][1]) <= SHARD_CHARS):
            k, words, n = queue[at]
            machine.add_word(f" {words} ", (at, len(words) + 2, n, words in known))
            scanned.add(k)
            size += len(words)
            at += 1
        machine.make_automaton()
        first: dict[tuple[int, int], tuple] = {}
        for k in sorted(scanned):
            for j, (_, did, th, start, _, words) in enumerate(groups[k]):
                text = f" {words} "
                offset = seen = 0
                for end, (number, length, n, before) in machine.iter(text):
                    begin = end - length + 1
                    offset += text.count(" ", seen, begin) - text.count(" ", begin, seen)  # hits go by their ends
                    seen = begin
                    here = (did, th, start + offset)
                    if before or first.setdefault((k, number), here) != here:
                        removed.setdefault((k, j), []).append((offset, n))
    for k, group in enumerate(groups):
        for j, row in enumerate(group):
            yield row, sorted(removed.get((k, j), ()))


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, n in runs:
        if out and at <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + n - out[-1][0]))
        else:
            out.append((at, n))
    return out


def single_windows(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Segments of one window each from runs of them, salted by the hash of the window's words: equal windows stay
    together, and the many different windows of one anchor part."""
    split = runs.withColumn("part", F.split(F.col("words").cast("string"), " "))
    each = split.select("ah", "did", "th", "start", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    words = F.array_join(F.slice("part", F.col("k") + 1, window), " ").cast("binary")
    one = each.select("ah", "did", "th", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n"), words.alias("words"))
    return one.select("ah", F.pmod(F.xxhash64("words"), F.lit((1 << 31) - 1)).cast("int").alias("salt"), "did", "th", "start", "n", "words")


def later_windows(found: DataFrame, window: int = WINDOW, final: bool = False) -> DataFrame:
    """(kind, ah, did, th, start, n, words) from segments: kind 0 is a run of windows that also start earlier, kind 1,
    from salted anchors only and not in the final pass, a run that is the first in its salt and still has to be held
    against the other salts.

    Segments are dealt by anchor and salt, sorted by document and place, and read as a stream: a task holds the rows
    of one shard and the distinct windows of one anchor at a time.
    """
    kind = found.schema["did"].dataType.simpleString()
    dealt = found.repartition("ah", "salt").sortWithinPartitions("ah", "salt", F.asc_nulls_last("did"), "th", "start")
    names = ["kind", "ah", "did", "th", "start", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        groups: list[list[Row]] = []
        anchors: list[int] = []
        known: set[str] = set()
        size, key = 0, None

        def flush(unfinished: bool) -> Iterator[pa.RecordBatch]:
            nonlocal groups, anchors, known, size
            # only a group that is alone can have known windows, as parts of a group are flushed by themselves
            passages = [confirm(g, known if k == 0 else set(), window) for k, g in enumerate(groups)]
            out: list[tuple] = []
            at = {id(r): a for g, a in zip(groups, anchors, strict=True) for r in g}
            for row, runs in locate(groups, passages, known):
                salt, did, th, start, n, words = row
                runs = _joined(runs)
                out += [(0, None, did, th, start + o, k, None) for o, k in runs]
                if salt and not final:
                    split, after = words.split(" "), 0
                    for o, k in [*runs, (n, 0)]:
                        if o > after:
                            out.append((1, at[id(row)], did, th, start + after, o - after, " ".join(split[after : o + window - 1]).encode("latin-1")))
                        after = o + k
            if unfinished:
                known.update(w for r in {(r[5], r[4]) for r in groups[0]} for w in windows_of(*r, window))
            else:
                known = set()
            groups, anchors, size = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            types = types or [pa.int32(), pa.int64(), batch.column(2).type, pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for ah, salt, did, th, start, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ah, salt) != key:
                    if known or size > SHARD_CHARS:
                        yield from flush(False)
                    key = (ah, salt)
                    groups.append([])
                    anchors.append(ah)
                elif (len(groups[-1]) >= PART_ROWS or size > PART_CHARS) and groups[-1][-1][1:4] != (did, th, start):
                    if len(groups) > 1:
                        last, name = groups.pop(), anchors.pop()
                        yield from flush(False)
                        groups, anchors = [last], [name]
                    yield from flush(True)
                    groups, anchors = [[]], [ah]
                groups[-1].append((salt, did, th, start, n, words.decode("latin-1")))
                size += len(words)
        if groups:
            yield from flush(False)

    return dealt.mapInArrow(releasing(run), f"kind int, ah bigint, did {kind}, th bigint, start bigint, n int, words binary")


def kept_words(raw: bytes, runs: Iterable[tuple[int, int]], window: int) -> tuple[list[bytes], list[bytes]]:
    """All words of a text, and those that no window of the runs (start, windows) covers."""
    words = raw.split()
    covered = np.zeros(len(words), bool)
    for start, n in runs:
        covered[start : start + n + window - 1] = True
    return words, [w for w, c in zip(words, covered.tolist(), strict=True) if not c] if covered.any() else words


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS, hot_least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """The rows (did, th, text) and the runs (did, th, start, n) of their windows that also start earlier."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES)
    rows = docs.select(F.col(id_col).alias("did"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(anchor_counts(rows.select("text"), window).filter("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = np.sort(np.array([r["ah"] for r in counts.filter(F.col("n") > max(hot_least, total // HOT_SHARE)).select("ah").collect()], "<i8"))
    bitmap, hot = spark.sparkContext.broadcast(recurring_filter(counts, filter_bits)), spark.sparkContext.broadcast(often)
    discard(counts)
    local = materialize(later_windows(segments(rows, bitmap, hot, window), window), "windows")
    across = single_windows(local.filter("kind = 1"), window)
    runs = local.filter("kind = 0").unionByName(later_windows(across, window, final=True)) if len(often) else local
    return rows, runs.filter("kind = 0").select("did", "th", "start", "n")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, filter_bits: int = FILTER_BITS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, and with with_text the kept text) for each row of docs.

    A word is removed if a window of `window` consecutive words over it also starts earlier: in a document of smaller
    id, or earlier in its own. Windows are judged on the input. Null ids come after all others; rows of one id with
    different texts come in order of the texts' hash; rows alike in id and text are one document and get the same
    result. A null text has no words; an empty table gives no rows; other columns are not read.
    """
    rows, runs = repeated_windows(docs, id_col, text_col, window, filter_bits, hot_least)
    per = runs.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    a, b = rows.alias("a"), per.alias("b")
    joined = a.join(b, F.col("a.did").eqNullSafe(F.col("b.did")) & (F.col("a.th") == F.col("b.th")), "left").select("a.did", "a.text", "b.runs")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest, texts = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, kept = kept_words(text or b"", ((r["start"], r["n"]) for r in found or ()), window)
                whole = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(whole).hexdigest())
                texts.append(whole.decode() if with_text else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(texts, pa.string())] if with_text else [])], names=["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return joined.mapInArrow(releasing(run), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else ""))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM t)),
later AS (SELECT rid, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i) > 1),
covered AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 20)) AS p FROM later)),
removed AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS whole FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM t)
         ANTI JOIN covered USING (rid, p) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(whole, '')) AS kept_sha256
FROM t LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
