"""Document sources over folders of files, read by Spark from any file system."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, _parse_datatype_string

from millrace.operators.chunking import Chunker
from millrace.sources.html import html_to_markdown

IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp")
DOCUMENT = ["path", "source_type", "source_file", "content", "metadata", "size", "modified_at"]


def files(spark: SparkSession, root: str, extensions: tuple[str, ...], ignore: list[str] | None = None) -> DataFrame:
    """(path, rel, content binary, size, modified_at) of the files under root, any depth, less the ignored ones.

    ignore holds .gitignore-style lines: globs of names or of paths from the root, a trailing / for folders, ! to take
    a file back; the last line that fits decides.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rpartition("://")[2]
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^.*?{_literal('/' + base.strip('/') + '/')}", "")
    rows = raw.select("path", rel.alias("rel"), "content", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"))
    rows = rows.filter(F.lower("rel").rlike(rf"\.({'|'.join(extensions)})$"))
    if not ignore:
        return rows
    lines = [x.strip() for x in ignore if x.strip() and not x.startswith("#")]

    @pandas_udf(BooleanType())
    def kept(names: pd.Series) -> pd.Series:
        return names.map(lambda n: not ignored(n, lines))

    return rows.filter(kept("rel"))


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def ignored(path: str, lines: list[str]) -> bool:
    parts = path.split("/")
    out = False
    for line in lines:
        back, pattern = line.startswith("!"), line.removeprefix("!")
        folder, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
        pattern = pattern.strip("/")
        ends = range(1, len(parts) + (not folder))
        if any(fnmatch.fnmatchcase("/".join(parts[:k]) if anchored else parts[k - 1], pattern) for k in ends):
            out = not back
    return out


def _document(rows: DataFrame, kind: str, metadata: Column) -> DataFrame:
    return rows.select("path", F.lit(kind).alias("source_type"), F.col("rel").alias("source_file"), F.col("text").alias("content"), metadata.alias("metadata"), "size", "modified_at")


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).filter("text is not null")


def markdown(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    return _document(_text(files(spark, root, ("md", "markdown"), ignore)), "markdown", F.lit("{}"))


@pandas_udf(StringType())
def _structure(texts: pd.Series) -> pd.Series:
    def one(text: str) -> str | None:
        try:
            value = json.loads(text)
        except ValueError:
            return None
        return "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "unknown"

    return texts.map(one)


def json_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, with the structure of their value, and the (path) of files that are not JSON."""
    rows = _text(files(spark, root, ("json",), ignore)).withColumn("structure", _structure("text"))
    good = rows.filter("structure is not null")
    return _document(good, "json", F.to_json(F.struct("structure"))), rows.filter("structure is null").select("path")


PAGE = "title string, url string, wikitext string, html string, description string, images array<string>, links array<string>, categories array<string>, entity_type string"


def mediawiki(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Pages: wikitext, else html, else title and description; space, type and entity type from the path
    space/type/by-type/entity_type/file; relations of the page's title from all graph.json files."""
    rows = _text(files(spark, root, ("json",), ignore))
    is_graph = F.lower("rel").rlike(r"(^|/)graph\.json$")
    relations = rows.filter(is_graph).select(F.explode(F.from_json("text", "map<string,array<string>>")).alias("title", "targets"))
    relations = relations.groupBy("title").agg(F.flatten(F.collect_list("targets")).alias("graph_relations"))
    pages = rows.filter(~is_graph).withColumn("p", F.from_json("text", PAGE)).filter("p is not null")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    both = F.concat_ws("\n\n", *(F.when(F.trim(F.col(f"p.{c}")) != "", F.col(f"p.{c}")) for c in ("title", "description")))
    parts = F.split("rel", "/")
    n = F.size(parts)
    place = F.when((n >= 5) & (F.lower(F.get(parts, n - 3)) == "by-type"), F.get(parts, n - 2))
    meta = pages.select(
        "path", "rel", "size", "modified_at", F.coalesce(filled("p.wikitext"), filled("p.html"), both).alias("text"), F.coalesce("p.title", F.lit("")).alias("title"), "p.url",
        F.when(n >= 2, parts[0]).alias("space"), F.when(n >= 3, parts[1]).alias("wiki_type"), F.coalesce(place, "p.entity_type", F.lit("")).alias("entity_type"),
        F.col("p.links").alias("page_links"), F.col("p.images").alias("image_paths"), "p.categories",
    )
    joined = meta.join(relations, "title", "left")
    return _document(joined, "mediawiki", F.to_json(F.struct("title", "url", "space", "wiki_type", "entity_type", "page_links", "image_paths", "categories", "graph_relations")))


def webpages(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Pages from md or html files, one for each folder and lower-case stem, md before html; static folders are left out."""
    rows = _text(files(spark, root, ("md", "html"), ignore)).filter(~F.col("rel").rlike(r"(^|/)static/"))
    if root.rstrip("/").rpartition("/")[2] == "static":
        rows = rows.limit(0)
    key = F.lower(F.regexp_replace("rel", r"\.[^./]*$", ""))
    folder = F.regexp_extract("rel", r"^(.*/)?[^/]*$", 1)
    kind = F.lower(F.regexp_extract("rel", r"\.([^./]*)$", 1))
    marked = rows.withColumn("key", F.concat(folder, F.substring_index(key, "/", -1))).withColumn("is_md", kind == "md")
    best = marked.groupBy("key").agg(F.max_by(F.struct("path", "rel", "text", "size", "modified_at", "is_md"), F.struct("is_md", "rel")).alias("b")).select("b.*")
    return _document(best.withColumn("text", F.when(F.col("is_md"), F.col("text")).otherwise(html_to_markdown("text"))), "webpage", F.lit("{}"))


def unstructured(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Markdown with the image names of its folder, and JSON."""
    folder = F.regexp_extract("rel", r"^(.*/)?[^/]*$", 1)
    images = files(spark, root, IMAGES, ignore).select(folder.alias("folder"), F.substring_index("rel", "/", -1).alias("name")).groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("image_paths"))
    md = _text(files(spark, root, ("md",), ignore)).withColumn("folder", folder).join(images, "folder", "left")
    return _document(md, "unstructured", F.to_json(F.struct("image_paths"))).unionByName(json_files(spark, root, ignore)[0])


SOURCES: dict[str, Callable[..., DataFrame]] = {"markdown": markdown, "json": lambda s, r, i=None: json_files(s, r, i)[0], "mediawiki": mediawiki, "webpage": webpages, "unstructured": unstructured}


class Registry:
    """Source types by name; a name twice or an unknown one is an error, an empty one is told from the path."""

    def __init__(self, sources: dict[str, Callable[..., DataFrame]] | None = None):
        self.sources = dict(SOURCES if sources is None else sources)

    def register(self, name: str, source: Callable[..., DataFrame]) -> None:
        if name in self.sources:
            raise ValueError(f"source type {name} is registered already")
        self.sources[name] = source

    def get(self, name: str, path: str = "") -> Callable[..., DataFrame]:
        name = name or detect_type(path)
        if name not in self.sources:
            raise ValueError(f"unknown source type {name}")
        return self.sources[name]


def detect_type(path: str) -> str:
    return "mediawiki" if "wiki" in path.lower() else "webpage" if "webpage" in path.lower() else "unstructured"


def with_domains(docs: DataFrame, domains: list[str]) -> DataFrame:
    """docs with the source's domains written into metadata.domain."""

    @pandas_udf(StringType())
    def put(bags: pd.Series) -> pd.Series:
        return bags.map(lambda b: json.dumps(json.loads(b or "{}") | {"domain": domains}, ensure_ascii=False))

    return docs.withColumn("metadata", put("metadata")) if domains else docs


def chunked(docs: DataFrame, settings: dict | None = None) -> DataFrame:
    """(path, seq, text, search_text, start_offset, end_offset, metadata): each document by the chunker of its source."""
    kinds = {"markdown": "markdown", "webpage": "markdown", "mediawiki": "mediawiki", "json": "json", "unstructured": "markdown"}
    chunkers = {t: Chunker(kind, **(settings or {})) for t, kind in kinds.items()}

    @pandas_udf(_parse_datatype_string("array<struct<seq:bigint,text:string,search_text:string,start:bigint,end:bigint,metadata:string>>"))
    def cut(texts: pd.Series, types: pd.Series, bags: pd.Series) -> pd.Series:
        out = []
        for text, kind, bag in zip(texts, types, bags, strict=True):
            out.append([c | {"metadata": json.dumps(json.loads(bag or "{}") | json.loads(c["metadata"]), ensure_ascii=False)} for c in chunkers[kind].chunk(text)])
        return pd.Series(out)

    rows = docs.select("path", F.explode(cut("content", "source_type", "metadata")).alias("c"))
    return rows.select("path", "c.seq", "c.text", "c.search_text", F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), "c.metadata")


def changed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with content_hash, less those that known (path, content_hash) has alike."""
    return docs.withColumn("content_hash", F.sha2("content", 256)).join(known, ["path", "content_hash"], "left_anti")
