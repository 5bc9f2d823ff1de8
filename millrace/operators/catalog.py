"""Lookups, filters, pages and counts over the knowledge tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MAX_PAGE = 20, 200


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in the one-column table ids."""
    return df.join(ids.toDF(id_col).distinct(), id_col, "left_semi")


def contains_folded(column: Column, part: str) -> Column:
    """Case-insensitive containment; %, _ and backslash are ordinary characters."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def where(df: DataFrame, **tests: tuple[str, object]) -> DataFrame:
    """Filters by column = (operator, value) with operators = and ~ (contains); an empty or None value is no filter."""
    for column, (operator, value) in tests.items():
        if value not in (None, ""):
            df = df.filter(contains_folded(F.col(column), str(value)) if operator == "~" else F.col(column) == value)
    return df


def json_values(bag: Column, path: str) -> Column:
    """An array-or-scalar member of a JSON string as array<string>; empty for a missing member or broken JSON."""
    value = F.get_json_object(bag, path)
    return F.coalesce(F.from_json(value, "array<string>"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))


def folded_name(df: DataFrame, name: str, name_col: str = "name", domain: str | None = None) -> DataFrame:
    """Rows whose trimmed lower-case name equals the normalized name, by id."""
    key = " ".join(name.split()).lower()
    found = df.filter(F.lower(F.trim(name_col)) == key)
    return (found.filter(F.col("domain") == domain) if domain else found).orderBy("id")


def page(df: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """One page by id, and the number of all rows."""
    return df.orderBy("id").offset(offset).limit(limit), df.count()


def ordered(df: DataFrame, *columns: str, descending: bool = False, id_col: str = "id") -> DataFrame:
    """Rows by the columns, all falling with descending, and by ascending id among equals."""
    return df.orderBy(*(F.desc(c) if descending else F.asc(c) for c in columns if c != id_col), id_col)


def created_since(df: DataFrame, since: object, column: str = "created_at") -> DataFrame:
    """Rows created after a moment; those of the moment itself and those without one fall out."""
    return df.filter(F.col(column) > F.lit(since))


def page_size(limit: int) -> int:
    return limit if 1 <= limit <= MAX_PAGE else PAGE


def encode_cursor(offset: int, limit: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset, "limit": limit}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, int]:
    """Offset and limit; anything else than what encode_cursor makes raises."""
    try:
        got = json.loads(base64.b64decode(cursor, validate=True))
        offset, limit = got["offset"], got["limit"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("bad cursor") from e
    if not isinstance(offset, int) or not isinstance(limit, int) or offset < 0:
        raise ValueError("bad cursor")
    return offset, limit


def next_cursor(offset: int, limit: int, total: int) -> str | None:
    return encode_cursor(offset + limit, limit) if offset + limit < total else None


def first_texts(chunks: DataFrame, chunk_entities: DataFrame, n: int) -> DataFrame:
    """(entity_id, chunk_id, search_text): the first n chunks of each entity by sequence and id."""
    rows = chunk_entities.join(chunks, "chunk_id")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "chunk_id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= n).select("entity_id", "chunk_id", "search_text")


def facts_of(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, fact columns): approved facts under each wanted endpoint, a self loop once."""
    ends = F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id")))
    each = facts.filter(F.col("status") == "approved").withColumn("entity_id", ends)
    return each.join(ids.toDF("entity_id").distinct(), "entity_id", "left_semi")


def search_facts(facts: DataFrame, entities: DataFrame, predicate: str | None = None, status: str | None = None, domain: str | None = None, entity: str | None = None) -> DataFrame:
    """Facts by predicate (contains), status, domain, and a name that either endpoint contains."""
    found = where(facts, predicate=("~", predicate), status=("=", status), domain=("=", domain))
    if entity:
        named = entities.filter(contains_folded(F.col("name"), entity)).select(F.col("id").alias("end"))
        hits = found.select("id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("end")).join(named, "end", "left_semi").select("id").distinct()
        found = found.join(hits, "id", "left_semi")
    return found


def fact_weights(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, weight): sources of each fact, 0 without any."""
    counts = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("weight"))
    return facts.select("id").join(counts, "id", "left").select("id", F.coalesce("weight", F.lit(0)).alias("weight"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_domains(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("domains").alias("domain")).distinct()


def health(documents: DataFrame, chunks: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(metric, value): rows of the four main tables, facts of any status."""
    out = None
    for name, df in (("documents", documents), ("chunks", chunks), ("entities", entities), ("facts", facts)):
        row = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def overview(documents: DataFrame, chunks: DataFrame, entities: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """(metric, value): rows of each table, facts of any status, distinct domains and types, link endpoints and rows."""
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    ends = links.select(F.col("subject_entity_id").alias("e")).union(links.select("target_entity_id")).distinct()
    parts = [
        one("documents", documents), one("chunks", chunks), one("entities", entities), one("facts", facts), one("links", links),
        one("domains", distinct_domains(documents)), one("source_types", documents.select("source_type").distinct()),
        one("entity_types", entities.select("type").distinct()), one("entity_domains", entities.select("domain").distinct()),
        one("predicates", facts.select("predicate").distinct()), one("graph_nodes", ends),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def delete(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose column is not in the one-column table ids."""
    return df.join(ids.toDF(column).distinct(), column, "left_anti")


def upsert(df: DataFrame, more: DataFrame, keys: list[str], order: list[str], first_wins: bool = True) -> DataFrame:
    """df with rows of more: keys df lacks are added once, by `order`; with first_wins False rows of more replace df's."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    one = more.withColumn("__r", rank).filter("__r = 1").drop("__r")
    if first_wins:
        return df.unionByName(one.join(df, keys, "left_anti").select(df.columns))
    return df.join(one, keys, "left_anti").select(df.columns).unionByName(one.select(df.columns))


def provenance(links: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): distinct values of each key in ascending order."""
    return links.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))
