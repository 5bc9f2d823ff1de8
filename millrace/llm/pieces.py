"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces of a public model file."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches, quoted, releasing

SPACE = "▁"
#: Bytes of each of the two generations of a worker's cache of encoded segments, as estimated by their sizes, and pair
#: tests that a worker keeps; those start anew when full.
CACHE_BYTES, PAIRS = 48 << 20, 1_000_000
#: Segments up to this length are cached; the search looks for a common boundary each so many characters; a text is
#: encoded in blocks of at least BLOCK characters, which end where no piece can go on.
LONGEST, COMMIT_EVERY, BLOCK = 64, 64, 1 << 16

# Piece types and model types of the public model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    dummy_prefix: bool

    @staticmethod
    def read(path: str) -> Vocabulary:
        """A BPE or unigram model whose normalizer is the identity."""
        out = Vocabulary([], [], [], False, True)
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece[1].decode())
                out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
                if kind not in (UNIGRAM, BPE):
                    raise ValueError(f"model type {kind} is neither unigram nor BPE")
                out.bpe = kind == BPE
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only the identity normalizer with escaped, unreduced white space is supported")
                out.dummy_prefix = bool(spec.get(3, 1))
        return out


@dataclass
class Codec:
    vocabulary: Vocabulary
    cache: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)
    held: int = 0
    rows: dict[str, dict] = field(default_factory=dict)
    tested: int = 0
    splits: dict[str, tuple[str, str] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self.ids = {p: k for k, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)) if kind in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)) if kind == BYTE}
        self.unknown = v.kinds.index(UNKNOWN)
        self.widest = max(map(len, self.ids))
        self.ranks = {p: k for k, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-v.scores[self.ids[p]], self.ids[p])))}
        self.machine = ahocorasick.Automaton()
        for piece, number in self.ids.items():
            if len(piece) > 1 or not v.bpe:  # what merges leave at a boundary where no longer piece is admitted is one character
                self.machine.add_word(piece, (len(piece) - 1, number))
        self.machine.make_automaton()
        self.matches = self.machine.iter if len(self.machine) else lambda text: iter(())
        self.single: dict[str, tuple[int, dict]] = {}
        self.floor = min(v.scores[k] for k in self.ids.values()) - 10.0
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, kind in zip(v.pieces, v.kinds, strict=True)]
        joined = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        inside = f"[{re.escape(joined)}]" if joined else "(?!)"
        # Every path has a boundary before a run of spaces and beside a character that no longer piece holds.
        self.segments = re.compile(f"{SPACE}*{inside}+|{SPACE}+|[^{re.escape(joined)}{SPACE}]" if not self.inner else r"(?s:.+)").findall

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text by byte-pair merges, the best-scored, then leftmost, adjacent pair first; and the last merge."""
        parts, ranks, last = list(text), self.ranks, None
        while len(parts) > 1:
            found = [(ranks[both], k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in ranks]
            if not found:
                break
            k = min(found)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge ends in this one, or None if merges of its characters do not end in it."""
        if (found := self.splits.get(piece, 0)) == 0:
            parts, last = self.merged(piece)
            found = self.splits[piece] = last if len(parts) == 1 else None
            if found and any(self.ranks[x] > self.ranks[piece] for x in found if len(x) > 1):
                raise ValueError(f"piece {piece!r} ranks before a part of it")
        return found

    def follows(self, left: str, right: str) -> bool:
        """Whether byte-pair merges leave the boundary between two adjacent pieces; left may be empty.

        Merges are undone from the last to the first on both sides of the boundary. While two symbols face each other,
        their own merge would have come first if it ranks before the one that is undone next; of equal ranks the left
        one comes first.
        """
        if len(right) > 1 and self.split(right) is None:
            return False
        ranks, limit = self.ranks, np.inf
        rank = lambda x: ranks[x] if len(x) > 1 else -1
        while left:
            if ranks.get(left + right, np.inf) < limit:
                return False
            a, b = rank(left), rank(right)
            if a > b:
                limit, left = a, self.split(left)[1]
            elif b < 0:
                break
            else:
                limit, right = b + 0.5, self.split(right)[0]
        return True

    def search(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text in order, as soon as they are certain.

        The automaton of all pieces gives those that end at each boundary, longest first. In a unigram model a boundary
        takes the best sum of scores; in a BPE model a piece is admitted only after a piece that merges would leave
        beside it, and exactly one path reaches each boundary, so the first admitted piece is taken, or else the last
        character, whether it is a piece or stands for itself. Live boundaries lie within the longest piece of the front; when their
        backpointers meet in one boundary, the ids before it are committed and forgotten.
        """
        return self._admitted(text) if self.vocabulary.bpe else self._best(text)

    def _row(self, piece: str) -> dict:
        """What is known about pieces after this one: by id the row of that piece, or False where it is refused."""
        if (found := self.rows.get(piece)) is None:
            found = self.rows[piece] = {-1: piece}
        return found

    def _test(self, row: dict, number: int) -> dict | bool:
        """The row of the piece of this id where it is admitted after the row's piece, else False."""
        piece = self.vocabulary.pieces[number]
        if self.tested >= PAIRS:
            self.rows, self.single, self.tested = {}, {}, 0
        self.tested += 1
        found = row[number] = self._row(piece) if self.follows(row[-1], piece) else False
        return found

    def _one(self, char: str) -> tuple[int, dict]:
        """Code and row of a single character; the code of one without a piece is -1 less its code point."""
        if (found := self.single.get(char)) is None:
            found = self.single[char] = self.ids.get(char, -1 - ord(char)), self._row(char)
        return found

    def _admitted(self, text: str) -> Iterator[bytes]:
        base, done, starts, codes, rows, single = 0, 0, [0], [0], [self._row("")], self.single
        for end, (back, number) in self.matches(text):
            if end < done:
                continue
            while done < end:
                starts.append(done)
                code, row = single.get(text[done]) or self._one(text[done])
                codes.append(code)
                rows.append(row)
                done += 1
            start = end - back
            row = rows[start - base]
            after = row.get(number)
            if after is None:
                after = self._test(row, number)
            if after is False:
                continue
            starts.append(start)
            codes.append(number)
            rows.append(after)
            done += 1
            if done - base > 2 * COMMIT_EVERY and (meet := self._meeting(starts, base, done)) > base:
                yield self._path(starts, codes, base, meet)
                starts, codes, rows, base = starts[meet - base :], codes[meet - base :], rows[meet - base :], meet
        while done < len(text):
            starts.append(done)
            codes.append(self._one(text[done])[0])
            done += 1
        yield self._path(starts, codes, base, done)

    def _best(self, text: str) -> Iterator[bytes]:
        scores = self.vocabulary.scores
        base, starts, codes, best = 0, [0], [0], [0.0]
        matches = self.matches(text)
        end, found = next(matches, (-1, None))
        for j in range(1, len(text) + 1):
            start, chosen, top = j - 1, -1 - ord(text[j - 1]), best[-1] + self.floor
            while end == j - 1:
                back, number = found
                if (total := best[end - back - base] + scores[number]) > top:
                    start, chosen, top = end - back, number, total
                end, found = next(matches, (-1, None))
            starts.append(start)
            codes.append(chosen)
            best.append(top)
            if j - base > 2 * COMMIT_EVERY and (meet := self._meeting(starts, base, j)) > base:
                yield self._path(starts, codes, base, meet)
                starts, codes, best, base = starts[meet - base :], codes[meet - base :], best[meet - base :], meet
        yield self._path(starts, codes, base, len(text))

    def _meeting(self, starts: list[int], base: int, front: int) -> int:
        """The boundary in which all paths to the boundaries within the longest piece of the front meet."""
        live = set(range(max(base, front - self.widest + 1), front + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(starts[top - base])
        return live.pop()

    def _path(self, starts: list[int], codes: list[int], base: int, end: int) -> bytes:
        """Ids between two boundaries; the code of a character without a piece is -1 less its code point."""
        out: list[int] = []
        while end > base:
            code = codes[end - base]
            end = starts[end - base]
            if code >= 0:
                out.append(code)
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(chr(-1 - code).encode())] if self.bytes else [self.unknown]
        out.reverse()
        return array("i", out).tobytes()

    def packed(self, segment: str) -> bytes:
        """Ids of a segment that the young generation lacks; a full young generation takes the old one's place."""
        found = self.old.get(segment) or b"".join(self.search(segment))
        if len(segment) <= LONGEST:
            self.held += 200 + len(segment) + len(found)
            if self.held > CACHE_BYTES:
                self.old, self.cache, self.held = self.cache, {}, 0
            self.cache[segment] = found
        return found

    def prepared(self, text: str) -> str:
        return (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def blocks(self, text: str) -> Iterator[str]:
        """The text in parts that are encoded by themselves: no piece reaches over the space that a part begins with."""
        text, at = self.prepared(text), 0
        while not self.inner and len(text) - at > 2 * BLOCK:
            end = text.find(SPACE, at + BLOCK)
            while end > 0 and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 4-byte integers, a block of segments at a time; a long segment as it is committed."""
        packed = self.packed
        for block in self.blocks(text):
            found = []
            for s in self.segments(block):
                if ids := self.cache.get(s):
                    found.append(ids)
                elif len(s) <= LONGEST:
                    found.append(packed(s))
                else:
                    yield b"".join(found)
                    found = []
                    yield from self.search(s)
            yield b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 4-byte integers."""
        return b"".join(self.stream(text))

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of ids: pieces joined, spaces unescaped, byte pieces read as UTF-8; at first, the dummy prefix removed."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if first and self.vocabulary.dummy_prefix and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if (found := _codecs.get(shared.id if hasattr(shared, "id") else id(shared))) is None:
        _codecs.clear()
        found = _codecs[shared.id if hasattr(shared, "id") else id(shared)] = Codec(shared.value)
    return found


class Returned:
    """The digest of what a text's ids decode to, and whether that is the text with U+2581 read as a space, part by part."""

    def __init__(self, codec: Codec, text: str):
        self.codec, self.text, self.at, self.same, self.first, self.digest = codec, text.replace(SPACE, " "), 0, True, True, hashlib.sha256()

    def add(self, ids: bytes) -> None:
        """The next ids; parts end between characters."""
        back = self.codec.decode(ids, self.first)
        self.first = self.first and not ids
        self.digest.update(back.encode())
        self.same = self.same and self.text.startswith(back, self.at)
        self.at += len(back)

    def result(self) -> tuple[str, bool]:
        return self.digest.hexdigest(), self.same and self.at == len(self.text)


def _returned(codec: Codec, text: str, ids: bytes) -> tuple[str, bool]:
    found = Returned(codec, text)
    found.add(ids)
    return found.result()


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", checked: bool = False) -> DataFrame:
    """docs with a column of the text's ids, as the library gives them without begin and end ids.

    With checked, decoded_sha256 and round_trip follow, as in digests. A null or empty text gets an empty array. Rows
    are independent; an empty table gives no rows. An added column takes the place of one of docs by that name.
    """
    added = [ids_col, *(["decoded_sha256", "round_trip"] if checked else [])]
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c not in added or c == text_col]
    docs = docs.select(*map(quoted, kept))
    shared, where = spark.sparkContext.broadcast(Vocabulary.read(model_file)), kept.index(text_col)
    names = [f"c{k}" for k in range(len(kept))]
    types = [t for _, t in docs.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            found = [codec.encode(t) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype="<i4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            more = []
            if checked:
                of_text, same = [], []
                for text, packed in zip(texts, found, strict=True):
                    digest, back = _returned(codec, text, packed)
                    of_text.append(digest)
                    same.append(back)
                more = [pa.array(of_text, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *more], names=[*names, "ids", "decoded_sha256", "round_trip"][: len(names) + len(added)])

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)) + ", ids array<int>" + (", decoded_sha256 string, round_trip boolean" if checked else "")
    out = docs.toDF(*names).mapInArrow(releasing(run), schema).toDF(*names, *(f"_{c}" for c in added))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True) if c not in added), *(F.col(f"_{c}").alias(c) for c in added))


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_sha256, decoded_sha256, round_trip) of each row's encoding and its decoding.

    ids_sha256 is over the ids as little-endian 4-byte integers; round_trip tells whether decoding gives the text back
    with U+2581 read as a space. A null text is encoded as an empty one. Nulls and repeats in id_col pass through.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.read(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, of_ids, of_text, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                size, digest, returned = 0, hashlib.sha256(), Returned(codec, text or "")
                for ids in codec.stream(text or ""):
                    size += len(ids) // 4
                    digest.update(ids)
                    returned.add(ids)
                n.append(size)
                of_ids.append(digest.hexdigest())
                of_text.append(returned.result()[0])
                same.append(returned.result()[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"id {kind}, n_ids bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with a column of the text that the array ids_col stands for, in place of one by that name; null ids give null."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.select(*(quoted(c) for c in rows.columns if c != text_col))
    shared, where = spark.sparkContext.broadcast(Vocabulary.read(model_file)), rows.columns.index(ids_col)
    names = [f"c{k}" for k in range(len(rows.columns))]
    types = [t for _, t in rows.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, "<i4").tobytes()) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)) + ", text string"
    return rows.toDF(*names).mapInArrow(releasing(run), schema).toDF(*rows.columns, text_col)
