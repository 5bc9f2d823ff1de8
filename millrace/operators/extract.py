"""Entities and facts out of chunks: regular expressions, model answers, thresholds, quotes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

AUTO_PUBLISH, MODEL_CONFIDENCE = 0.85, 0.5
DESCRIPTION, WINDOW, FALLBACK = 500, 60, 120
ENTITY = "id bigint, name string, type string, domain string, description string, confidence double, metadata string"
FACT = "id bigint, subject_type string, subject_name string, predicate string, object_type string, object_name string, domain string, metadata string"


@dataclass(frozen=True)
class Pattern:
    """A rule of the regular-expression extractor; Java syntax, Unicode classes."""

    type: str
    pattern: str
    domain: str = ""
    confidence: float = 1.0


def by_patterns(chunks: DataFrame, patterns: list[Pattern], id_col: str = "chunk_id", text_col: str = "search_text") -> DataFrame:
    """(id, name, type, domain, confidence): trimmed matches of each rule, once a chunk; the first group if there is one."""
    out = None
    for p in patterns:
        group = 1 if re.compile(p.pattern).groups else 0
        names = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"(?U){p.pattern}"), F.lit(group)), lambda x: F.trim(x))))
        rows = chunks.select(F.col(id_col).alias("id"), names.alias("name"), F.lit(p.type.lower()).alias("type"), F.lit(p.domain).alias("domain"), F.lit(float(p.confidence)).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("name <> ''").dropDuplicates(["id", "name", "type", "domain"])


class Provider(Protocol):
    """Answers a prompt about a text with JSON: entities and relations."""

    def answer(self, text: str, domain: str) -> str: ...


def cache_key(*parts: object) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def shortened(text: str) -> str:
    """At most 500 characters, cut after the last sentence end if there is one."""
    text = text.strip()
    if len(text) <= DESCRIPTION:
        return text
    ends = [m.end() for m in re.finditer(r"[.!?;]", text[:DESCRIPTION])]
    return text[: ends[-1]].strip() if ends else text[:DESCRIPTION]


def clean_attributes(values: dict) -> dict:
    """Attributes without guesses and without versions that are none."""
    # fixed values: what a model writes beside a guess
    guess = ("implied by context", "not explicitly stated")
    keep = lambda k, v: not isinstance(v, str) or not (any(g in v.lower() for g in guess) or (k.lower() == "version" and not re.fullmatch(r"[vV]?\d+(\.\d+)*([.-]?[A-Za-z0-9]+)?", v.strip())))
    return {k: v for k, v in values.items() if keep(k, v)}


def parse_answer(raw: str) -> tuple[list[dict], list[dict]]:
    """Entities and facts of a model's JSON answer; nameless entities and relations with an empty part fall out."""
    got = json.loads(raw)
    entities = [
        {"name": e["name"], "type": e.get("type", ""), "description": shortened(e.get("description", "")), "confidence": c if isinstance(c := e.get("confidence"), int | float) and 0 <= c <= 1 else MODEL_CONFIDENCE, "metadata": json.dumps(clean_attributes(e.get("attributes", {})), ensure_ascii=False)}
        for e in got.get("entities", [])
        if e.get("name")
    ]
    parts = ("subject_type", "subject_name", "predicate", "object_type", "object_name")
    facts = [{p: r[p] for p in parts} | {"metadata": json.dumps(clean_attributes(r.get("attributes", {})), ensure_ascii=False)} for r in got.get("relations", []) if all(r.get(p) for p in parts)]
    return entities, facts


def by_provider(chunks: DataFrame, provider: Provider, domain: str, cache: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "search_text") -> DataFrame:
    """(id, key, answer) of each chunk, asked on the executors; answers known to cache (key, answer) are not asked for."""
    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(F.concat(F.lit(f"{domain}:"), text_col), 256).alias("key"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "answer": [provider.answer(t, domain) for t in b["text"]]})

    schema = "id bigint, key string, answer string"
    if cache is None:
        return rows.mapInPandas(ask, schema)
    known = rows.join(cache, "key").select("id", "key", "answer")
    return known.unionByName(rows.join(cache, "key", "left_anti").select("id", "text", "key").mapInPandas(ask, schema))


def parsed(answers: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Entity and fact rows of answers (id, answer); a broken answer raises."""

    def rows(kind: int, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [{"id": i, "domain": domain} | x for i, a in zip(b["id"], b["answer"], strict=True) for x in parse_answer(a)[kind]]
                yield pd.DataFrame(found, columns=columns)

        return run

    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return answers.mapInPandas(rows(0, names(ENTITY)), ENTITY), answers.mapInPandas(rows(1, names(FACT)), FACT)


PROVIDER = "provider"
#: Metadata of a document that does not belong to an entity of it.
DOCUMENT_FIELDS = ("url", "image_paths", "page_links", "categories")


def overlaid(metadata: Column, source: Column, provider: str) -> Column:
    """JSON metadata of a finding with its chunk's own laid over it, and the provider's name where none is given.

    Values keep their types; a null or broken object counts as empty.
    """
    return _overlaid(metadata, source, F.lit(provider))


@pandas_udf(StringType())
def _overlaid(metadata: pd.Series, source: pd.Series, provider: pd.Series) -> pd.Series:
    def one(own: str | None, over: str | None, name: str) -> str:
        out = _object(own) | _object(over)
        out.setdefault(PROVIDER, name)
        return json.dumps(out, ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(metadata, source, provider, strict=True)], dtype=object)


def _object(text: str | None) -> dict:
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def scoped_metadata(name: str, metadata: dict) -> dict:
    """An entity's metadata without its document's fields, in any case of letters; a title that is text becomes the
    entity's name, and provenance stays."""
    out = {k: v for k, v in metadata.items() if k.lower() not in DOCUMENT_FIELDS}
    if isinstance(metadata.get("title"), str):
        out["title"] = name
    return out


@pandas_udf(StringType())
def scoped(names: pd.Series, metadata: pd.Series) -> pd.Series:
    """scoped_metadata over columns of names and JSON objects."""
    return pd.Series([json.dumps(scoped_metadata(n, _object(m)), ensure_ascii=False) for n, m in zip(names, metadata, strict=True)], dtype=object)


def composite(chunks: DataFrame, providers: list[tuple[str, Provider]], domain: str, thresholds: dict[str, float] | None = None, metadata_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and facts of all providers (name, provider) in turn, published by confidence.

    Each finding carries its chunk's metadata over its own and the provider's name; an error of any provider ends the
    job, so there are no partial results. Without providers there is nothing.
    """
    spark = chunks.sparkSession
    if not providers:
        return spark.createDataFrame([], ENTITY), spark.createDataFrame([], FACT)
    bag = chunks.select(F.col("chunk_id").alias("id"), (F.col(metadata_col) if metadata_col else F.lit(None).cast("string")).alias("source"))
    found: list[list[DataFrame]] = [[], []]
    for name, provider in providers:
        answers = by_provider(chunks, provider, domain).select("id", "answer")
        for k, rows in enumerate(parsed(answers, domain)):
            found[k].append(rows.join(bag, "id").withColumn("metadata", overlaid(F.col("metadata"), F.col("source"), name)).select(rows.columns))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return published(union(found[0]), union(found[1]), thresholds)


def published(entities: DataFrame, facts: DataFrame, thresholds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities at or above their domain's threshold (0.85 by default), and facts of a chunk both of whose ends stay."""
    least = F.coalesce(*(F.when(F.col("domain") == d, F.lit(float(t))) for d, t in (thresholds or {}).items()), F.lit(AUTO_PUBLISH))
    kept = entities.filter(F.col("confidence") >= least)
    ends = lambda s: kept.select("id", F.col("type").alias(f"{s}_type"), F.col("name").alias(f"{s}_name")).distinct()
    return kept, facts.join(ends("subject"), ["id", "subject_type", "subject_name"], "left_semi").join(ends("object"), ["id", "object_type", "object_name"], "left_semi")


def stored_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject_entity_id, predicate, object_entity_id, status, weight): facts of named ends to ids, approved.

    Ends are looked up by type, normalized name and the fact's domain, so facts across domains or with an unknown end
    fall out; equal facts become one whose weight is the number of distinct documents (doc_id).
    """
    from millrace.functions.text import normalize

    known = entities.select("id", "type", normalize(F.col("name")).alias("k"), "domain")
    end = lambda s: known.select(F.col("id").alias(f"{s}_entity_id"), F.col("type").alias(f"{s}_type"), F.col("k").alias(f"{s}_k"), "domain")
    keyed = facts.withColumn("subject_k", normalize(F.col("subject_name"))).withColumn("object_k", normalize(F.col("object_name")))
    found = keyed.join(end("subject"), ["subject_type", "subject_k", "domain"]).join(end("object"), ["object_type", "object_k", "domain"])
    return found.groupBy("subject_entity_id", "predicate", "object_entity_id").agg(F.countDistinct("doc_id").alias("weight")).withColumn("status", F.lit("approved"))


def quote(text: Column, subject: Column, object_: Column) -> Column:
    """What stands around the earlier of two names: 60 characters on either side, else the first 120.

    If anything is cut off, the quote ends before its last line break and with three dots. Case is folded as far as
    that keeps lengths, which holds for all but a few letters.
    """
    at = lambda name: F.nullif(F.when(F.length(name) > 0, F.position(F.lower(name), F.lower(text))).otherwise(0), F.lit(0))
    s, o = at(subject), at(object_)
    first = F.least(s, o)
    length = F.when(s == first, F.length(subject)).otherwise(F.length(object_))
    start, end = F.greatest(first - WINDOW, F.lit(1)), F.least(first + length + WINDOW, F.length(text) + 1)
    around = F.substring(text, start, end - start)
    cut = F.when(first.isNull(), F.length(text) > FALLBACK).otherwise((start > 1) | (end <= F.length(text)))
    body = F.when(first.isNull(), F.substring(text, F.lit(1), F.lit(FALLBACK))).otherwise(around)
    lines = F.when(body.rlike(r"[\n\r]"), F.trim(F.regexp_replace(body, r"[\n\r][^\n\r]*\z", ""))).otherwise(body)
    return F.when(cut, F.when(F.endswith(lines, F.lit("...")), lines).otherwise(F.concat(lines, F.lit("...")))).otherwise(F.when(first.isNull(), text).otherwise(body))
