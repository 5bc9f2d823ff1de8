"""Hybrid search: both legs, fusion, enrichment, reranking and graph expansion."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import fusion, graph, lexical, vectors

TOP_K = 10


@dataclass(frozen=True)
class Settings:
    lexical_top_k: int = 50
    semantic_top_k: int = 50
    rrf_k: int = fusion.RRF_K
    use_lexical: bool = True
    use_semantic: bool = True
    boosts: fusion.Boosts = field(default_factory=fusion.Boosts)


def enrich(results: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """results with their chunk's text and document fields; a result without a chunk falls out, one without a document
    stays. The results are the small side of each join: at most both legs' limits."""
    found = chunks.select("chunk_id", "doc_id", "search_text").join(F.broadcast(results), "chunk_id")
    small = F.broadcast(found)
    docs = documents.select(F.col("id").alias("doc_id"), "original_path", F.col("source_type").alias("doc_source_type"), "domains", "is_official", "is_deprecated", "updated_at", *(["valid_to"] if "valid_to" in documents.columns else []))
    out = docs.join(small, "doc_id", "right")
    return out if "valid_to" in out.columns else out.withColumn("valid_to", F.lit(None).cast("bigint"))


def with_entities(results: DataFrame, chunk_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """results with an array of their entities (id, name, type), by name and id; empty without any."""
    named = chunk_entities.join(F.broadcast(results.select("chunk_id").distinct()), "chunk_id").join(entities, chunk_entities.entity_id == entities.id)
    lists = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", "type"))).alias("entities"))
    return results.join(lists, "chunk_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(lists.schema["entities"].dataType)))


def expand(results: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, options: graph.Options = graph.Options()) -> DataFrame:
    """results with related_entities: for each of their entities that is a node, the edges of its neighbourhood, walked
    breadth-first within its domain, and its approved facts. All entities are walked together."""
    wanted = results.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", F.col("e.id").alias("entity_id"))
    wanted = wanted.join(nodes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    ids = F.broadcast(wanted.select("entity_id").distinct())
    ends = lambda df, a, b: df.withColumn("entity_id", F.explode(F.array_distinct(F.array(a, b)))).join(ids, "entity_id", "left_semi")
    walked = graph.traverse_many(nodes, edges, wanted.select("entity_id"), options).withColumnRenamed("origin", "entity_id")
    near = walked.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("depth", "from_id", "to_id", "relation", "kind"))).alias("edges"))
    known = ends(facts.filter(F.col("status") == "approved"), "subject_entity_id", "object_entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("subject_entity_id", "predicate", "object_entity_id"))).alias("facts"))
    each = wanted.join(near, "entity_id", "left").join(known, "entity_id", "left")
    lists = each.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "edges", "facts"))).alias("related_entities"))
    return results.join(lists, "chunk_id", "left")


def hybrid(chunks: DataFrame, documents: DataFrame, table: DataFrame, query: str, embed: Callable[[str], Sequence[float]], as_of: int, top_k: int = TOP_K, domain: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """The top_k chunks for a query, best first, with rank, score, source_type and their document.

    A blank query gives no rows. A leg that fails is left out with a warning; if no leg is left, its error is raised.
    The candidates are cut to the larger of the legs' limits before the boosts, as fusion ranks them.
    """
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be within 1 and 100")
    if not query.strip():
        empty = chunks.select("chunk_id", F.lit(0.0).alias("score"), F.lit("").alias("source_type"), F.lit(0).alias("prior")).limit(0)
        return fusion.rerank(enrich(empty, chunks, documents), as_of, settings.boosts)
    legs, failed = {}, None
    makers = {
        "lexical": (settings.use_lexical, lambda: lexical.search(chunks, query, settings.lexical_top_k, domain)),
        "semantic": (settings.use_semantic, lambda: vectors.semantic(table, chunks, embed(query), settings.semantic_top_k, domain)),
    }
    for name, (used, make) in makers.items():
        if used:
            try:
                legs[name] = make()
            except Exception as e:  # noqa: BLE001 - a failed leg degrades the search
                warnings.warn(f"{name} search failed: {e}", stacklevel=2)
                failed = e
    if not legs:
        raise failed or ValueError("both legs are switched off")
    if len(legs) == 2:
        fused = fusion.fuse(legs["lexical"], legs["semantic"], settings.rrf_k, max(settings.lexical_top_k, settings.semantic_top_k))
        ranked = fused.withColumn("prior", F.row_number().over(fusion.Window.orderBy(F.desc("score"), "chunk_id")))
    else:
        name, leg = next(iter(legs.items()))
        ranked = fusion.standalone(leg, name)
    return fusion.rerank(enrich(ranked, chunks, documents), as_of, settings.boosts).limit(top_k)
