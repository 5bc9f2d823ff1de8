"""Documents into chunks with exact byte offsets."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.functions.arrays import let

MAX_CHARS, OVERLAP = 1000, 100
# The JSON fields that hold text.
TEXT_FIELDS = ("description", "title", "wikitext", "html")
CHUNKS = "array<struct<seq:bigint,text:string,search_text:string,start:bigint,end:bigint,metadata:string>>"


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """(id, seq, text, start_offset, end_offset and the document's columns keep): windows of max_chars characters, offsets
    in bytes. Built-ins only.

    Steps are max_chars - overlap, or max_chars where that is not positive; the last window ends with the text. Blank
    and null texts give no chunk.
    """
    size, step = max(1, max_chars), max(1, max_chars) - overlap if overlap < max(1, max_chars) else max(1, max_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"), *keep).filter(F.length(F.trim("whole")) > 0)
    last = F.greatest(F.lit(0), F.ceil((F.length("whole") - size) / F.lit(step))).cast("int")
    # one pass cuts the text into steps; windows and offsets come from those, so a long text costs no more a window
    steps = F.regexp_extract_all(F.col("whole"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    sums = lambda p: F.aggregate(p, F.array(F.lit(0).cast("bigint")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.octet_length(x))))
    window = lambda p, s, k: F.struct(k.cast("bigint").alias("seq"), F.substring(F.array_join(F.slice(p, k + 1, -(-size // step)), ""), F.lit(1), F.lit(size)).alias("text"), F.get(s, k).alias("start_offset"))
    cut = let(steps, lambda p: let(sums(p), lambda s: F.transform(F.sequence(F.lit(0), last), lambda k: window(p, s, k))))
    out = rows.select("id", *keep, F.explode(cut).alias("c"))
    return out.select("id", "c.seq", "c.text", "c.start_offset", (F.col("c.start_offset") + F.octet_length("c.text")).alias("end_offset"), *keep)


def spans(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Fixed windows over n characters."""
    size = max(1, size)
    step = size - overlap if overlap < size else size
    count = 1 if n <= size else -(-(n - size) // step) + 1
    return [(k * step, min(n, k * step + size)) for k in range(count)]


@dataclass
class Heading:
    level: int
    title: str
    at: int


# Headings: one to six marks and white space before a title; or equal runs of = around it.
_ATX = re.compile(r"^(#{1,6})[ \t\r\x0b\x0c](.*)$", re.MULTILINE)
_WIKI = re.compile(r"^([^\S\n]*)(={1,6})(?!=)(.*?)(?<!=)\2[^\S\n]*$", re.MULTILINE)
_IMAGE = re.compile(r"!\[[^\]]*\]\(([^)]*)\)")
_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?((?:(?!\]\]).)*)\]\]", re.DOTALL)


def markdown_headings(text: str) -> list[Heading]:
    return [Heading(len(m[1]), m[2].strip(), m.start()) for m in _ATX.finditer(text) if m[2].strip()]


def wiki_headings(text: str) -> list[Heading]:
    return [Heading(len(m[2]), m[3].strip(), m.start()) for m in _WIKI.finditer(text) if m[3].strip()]


def _plain_markdown(title: str) -> str:
    return title.replace("*", "").replace("`", "").strip()


def unwrap_links(text: str) -> str:
    return _LINK.sub(lambda m: m[1], text)


def _plain_wiki(title: str) -> str:
    return unwrap_links(title).replace("'''", "").replace("''", "").replace("`", "").strip()


def breadcrumb(headings: list[Heading], k: int, plain) -> str:
    """The nearest headings of falling level above heading k, then its own, each a space further in."""
    path, level = [headings[k].title], headings[k].level
    for h in reversed(headings[:k]):
        if h.level < level:
            path.append(h.title)
            level = h.level
    return "\n".join(f"{' ' * depth}> {plain(t)}" for depth, t in enumerate(reversed(path)))


def _bytes_at(text: str):
    """Byte offset of a character index, from sums at each line."""
    lines = text.splitlines(keepends=True) or [""]
    chars = [0, *accumulate(map(len, lines))]
    sizes = [0, *accumulate(len(x.encode()) for x in lines)]

    def offset(at: int) -> int:
        k = min(bisect_right(chars, at), len(lines)) - 1
        return sizes[k] + len(text[chars[k] : at].encode())

    return offset


@dataclass
class Chunker:
    """Cuts one text; kind is markdown, mediawiki, json or fixed."""

    kind: str = "markdown"
    max_chars: int = MAX_CHARS
    overlap: int = OVERLAP
    fields: tuple[str, ...] = TEXT_FIELDS
    combine: bool = True
    max_objects: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("markdown", "mediawiki", "json", "fixed"):
            raise ValueError(f"unknown chunking strategy {self.kind}")
        if self.overlap < 0:
            self.overlap = OVERLAP

    def chunk(self, text: str | None) -> list[dict]:
        if not text or not text.strip():
            return []
        offset = _bytes_at(text)
        cuts = {"markdown": self._sections, "mediawiki": self._sections, "json": self._json, "fixed": self._fixed}[self.kind](text)
        return [
            {"seq": k, "text": text[a:b], "search_text": f"{crumb}\n\n{text[a:b]}" if crumb and self.kind == "markdown" else text[a:b], "start": offset(a), "end": offset(b), "metadata": json.dumps(self.extra | meta, ensure_ascii=False)}
            for k, (a, b, meta, crumb) in enumerate(cuts)
        ]

    def _fixed(self, text: str) -> Iterator[tuple[int, int, dict, str]]:
        for a, b in spans(len(text), self.max_chars, self.overlap):
            yield a, b, {}, ""

    def _images(self, text: str) -> dict:
        found = _IMAGE.findall(text) if self.kind == "markdown" else []
        return {"image_paths": found} if found else {}

    def _sections(self, text: str) -> Iterator[tuple[int, int, dict, str]]:
        markdown = self.kind == "markdown"
        headings, plain = (markdown_headings(text), _plain_markdown) if markdown else (wiki_headings(text), _plain_wiki)
        first = headings[0].at if headings else len(text)
        if not headings or text[:first].strip():
            yield 0, first, self._images(text[:first]), ""
        for k, h in enumerate(headings):
            end = headings[k + 1].at if k + 1 < len(headings) else len(text)
            body = text[h.at : end].partition("\n")[2]
            if not body.strip():
                continue
            crumb = breadcrumb(headings, k, plain)
            meta = {"section_title": h.title, "heading_level": h.level, "breadcrumb": crumb} | self._images(body)
            for a, b in spans(end - h.at, self.max_chars, self.overlap):
                yield h.at + a, h.at + b, meta, crumb

    def _json(self, text: str) -> Iterator[tuple[int, int, dict, str]]:
        value, start, end = read_json(text, 0)
        if text[end:].strip(" \t\r\n"):
            raise ValueError("text after the JSON value")
        if isinstance(value, dict):
            yield from self._object(text, value, start, end, 0)
        elif isinstance(value, list):
            for k, (item, a, b) in enumerate(elements(text, start)):
                if self.max_objects > 0 and k >= self.max_objects:
                    break
                if isinstance(item, dict):
                    yield from self._object(text, item, a, b, k)
        else:
            yield 0, len(text), {}, ""

    def _object(self, text: str, item: dict, start: int, end: int, index: int) -> Iterator[tuple[int, int, dict, str]]:
        filled = [k for k, v in item.items() if isinstance(v, str) and v]
        if self.combine:
            used = [f for f in self.fields if f in filled] or filled
            if used:
                yield start, end, {"object_index": index, "text_fields": used}, ""
            return
        places: dict[str, tuple[int, int]] = {}
        for key, _, a, b in members(text, start):
            places.setdefault(key, (a, b))
        for f in self.fields:
            if f in filled and f in places:
                yield *places[f], {"object_index": index, "field_name": f}, ""


def _refuse(word: str):
    raise ValueError(f"{word} is not JSON")


_JSON = json.JSONDecoder(parse_constant=_refuse)
_BLANK = re.compile(r"[ \t\r\n]*")


def read_json(text: str, at: int) -> tuple[object, int, int]:
    """The value at or after a place, and where it starts and ends."""
    start = _BLANK.match(text, at).end()
    value, end = _JSON.raw_decode(text, start)
    return value, start, end


def elements(text: str, start: int) -> Iterator[tuple[object, int, int]]:
    """Values of the array that starts at a place, with their spans."""
    at = _BLANK.match(text, start + 1).end()
    while text[at] != "]":
        value, a, b = read_json(text, at)
        yield value, a, b
        at = _BLANK.match(text, b).end()
        at = _BLANK.match(text, at + 1).end() if text[at] == "," else at


def members(text: str, start: int) -> Iterator[tuple[str, object, int, int]]:
    """Keys and values of the object that starts at a place, with the values' spans."""
    at = _BLANK.match(text, start + 1).end()
    while text[at] != "}":
        key, _, end = read_json(text, at)
        value, a, b = read_json(text, _BLANK.match(text, end).end() + 1)
        yield key, value, a, b
        at = _BLANK.match(text, b).end()
        at = _BLANK.match(text, at + 1).end() if text[at] == "," else at


def structured_chunks(docs: DataFrame, chunker: Chunker, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, text, search_text, start_offset, end_offset, metadata) of every document; broken JSON raises."""
    from pyspark.sql.types import _parse_datatype_string

    @pandas_udf(_parse_datatype_string(CHUNKS))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(chunker.chunk)

    rows = docs.select(F.col(id_col).alias("id"), F.explode(cut(F.col(text_col))).alias("c"))
    return rows.select("id", "c.seq", "c.text", "c.search_text", F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), "c.metadata")


def image_paths(text: Column) -> Column:
    """Targets of Markdown images."""
    return F.regexp_extract_all(text, F.lit(_IMAGE.pattern), F.lit(1))
