"""The twelve read-only tools over one knowledge base; rows come back as DataFrames, pages as (rows, total, cursor)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import catalog, graph, search


class ToolError(ValueError):
    """A call that names nothing, too much, or several things."""


@dataclass
class Tools:
    """tables: documents, chunks, entities, facts, fact_sources, entity_sources, entity_links, entity_aliases,
    chunk_entities, vectors."""

    tables: dict[str, DataFrame]
    embed: Callable[[str], Sequence[float]]
    as_of: int

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        t = self.tables
        return graph.nodes(t["entities"]), graph.edges(t["entities"], t["facts"], t["entity_links"])

    def _page(self, rows: DataFrame, limit: int, cursor: str | None) -> tuple[DataFrame, int, str | None]:
        offset, size = catalog.decode_cursor(cursor) if cursor else (0, catalog.page_size(limit))
        found, total = catalog.page(rows, offset, size)
        return found, total, catalog.next_cursor(offset, size, total)

    def entity_id(self, id: int | None = None, name: str | None = None, domain: str | None = None) -> int:
        """An entity by id or by name; a name that several have is an error that lists them."""
        if (id is None) == (not name):
            raise ToolError("give an id or a name")
        found = self.tables["entities"].filter(F.col("id") == id) if id is not None else catalog.folded_name(self.tables["entities"], name, domain=domain)
        rows = found.select("id", "type", "domain").limit(20).collect()
        if not rows:
            raise ToolError("no such entity")
        if len(rows) > 1:
            raise ToolError("ambiguous name: " + ", ".join(f"{r['id']} ({r['type']}, {r['domain']})" for r in rows))
        return rows[0]["id"]

    def search(self, query: str, top_k: int = search.TOP_K, domain: str | None = None, settings: search.Settings = search.Settings()) -> DataFrame:
        t = self.tables
        if domain and catalog.distinct_domains(t["documents"]).filter(F.col("domain") == domain).isEmpty():
            warnings.warn(f"domain {domain} is unknown", stacklevel=2)
        found = search.hybrid(t["chunks"], t["documents"], t["vectors"], query, self.embed, self.as_of, top_k, domain, settings)
        named = search.with_entities(found, t["chunk_entities"], t["entities"])
        return search.expand(named, *self._graph(), t["facts"])

    def catalog_overview(self) -> DataFrame:
        t = self.tables
        return catalog.overview(t["documents"], t["chunks"], t["entities"], t["facts"], t["entity_links"])

    def catalog_documents(self, source_type: str | None = None, domain: str | None = None, limit: int = 20, cursor: str | None = None):
        rows = catalog.where(self.tables["documents"], source_type=("=", source_type))
        return self._page(rows.filter(F.array_contains("domains", domain)) if domain else rows, limit, cursor)

    def catalog_entities(self, type: str | None = None, domain: str | None = None, name: str | None = None, limit: int = 20, cursor: str | None = None):
        return self._page(catalog.where(self.tables["entities"], type=("=", type), domain=("=", domain), name=("~", name)), limit, cursor)

    def search_entities_by_type(self, type: str, limit: int = 20, cursor: str | None = None):
        if not type:
            raise ToolError("a type is needed")
        return self.catalog_entities(type=type, limit=limit, cursor=cursor)

    def search_facts(self, predicate: str | None = None, entity: str | None = None, domain: str | None = None, status: str = "approved", limit: int = 20, cursor: str | None = None):
        return self._page(catalog.search_facts(self.tables["facts"], self.tables["entities"], predicate, status, domain, entity), limit, cursor)

    def get_fact_by_id(self, id: int) -> DataFrame:
        """A fact of any status with its documents."""
        fact = self.tables["facts"].filter(F.col("id") == id)
        docs = catalog.provenance(self.tables["fact_sources"].filter(F.col("fact_id") == id), "fact_id", "document_id")
        return fact.join(docs.select(F.col("fact_id").alias("id"), F.col("values").alias("documents")), "id", "left")

    def get_chunk_by_id(self, id: int) -> DataFrame:
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        row = self.tables["chunks"].filter(F.col("chunk_id") == id)
        return row.select(*(zero(c) if c in ("start_offset", "end_offset") else F.col(c) for c in row.columns))

    def get_document_context(self, id: int, chunks: bool = True, entities: bool = True, facts: bool = False) -> dict[str, DataFrame]:
        t = self.tables
        out = {"document": t["documents"].filter(F.col("id") == id)}
        if chunks:
            out["chunks"] = t["chunks"].filter(F.col("doc_id") == id).orderBy("seq", "chunk_id")
        if entities:
            own = t["entity_sources"].filter(F.col("document_id") == id).select(F.col("entity_id").alias("id"))
            out["entities"] = catalog.by_ids(t["entities"], own).orderBy("name", "id")
        if facts:
            own = t["fact_sources"].filter(F.col("document_id") == id).select(F.col("fact_id").alias("id"))
            out["facts"] = catalog.by_ids(t["facts"], own).orderBy("id")
        return out

    def get_entity_relations(self, id: int | None = None, name: str | None = None, depth: int = 2, options: graph.Options | None = None) -> tuple[DataFrame, DataFrame]:
        if not 1 <= depth <= 10:
            raise ToolError("depth must be within 1 and 10")
        o = options or graph.Options()
        return graph.traverse(*self._graph(), self.entity_id(id, name), graph.Options(depth, o.max_nodes, o.direction, o.relations, o.follow_links))

    def get_entity_links(self, id: int | None = None, name: str | None = None) -> DataFrame:
        """(target, relation_type, method, confidence): links of either direction, one for each target and relation: of
        higher confidence, with a method, by the least method."""
        i = self.entity_id(id, name)
        links = self.tables["entity_links"]
        touched = links.filter((F.col("subject_entity_id") == i) | (F.col("target_entity_id") == i))
        other = F.when(F.col("subject_entity_id") == i, F.col("target_entity_id")).otherwise(F.col("subject_entity_id"))
        rank = F.row_number().over(Window.partitionBy("target", "relation_type").orderBy(F.desc("confidence"), F.col("method").isNull(), "method"))
        return touched.select(other.alias("target"), "relation_type", "method", "confidence").withColumn("r", rank).filter("r = 1").drop("r")

    def get_entity_dossier(self, id: int | None = None, name: str | None = None, depth: int = 2) -> dict[str, DataFrame]:
        """The entity with its aliases, documents, at most 100 facts, neighbourhood of at most 100 nodes and links."""
        if not 1 <= depth <= 5:
            raise ToolError("depth must be within 1 and 5")
        i, t = self.entity_id(id, name), self.tables
        one = t["entities"].filter(F.col("id") == i)
        facts = catalog.facts_of(t["facts"], one.select("id")).orderBy(F.desc("id")).limit(100)
        nodes, edges = graph.traverse(*self._graph(), i, graph.Options(max_depth=depth, max_nodes=100))
        docs = catalog.by_ids(t["documents"], t["entity_sources"].filter(F.col("entity_id") == i).select(F.col("document_id").alias("id")))
        return {"entity": one, "aliases": t["entity_aliases"].filter(F.col("entity_id") == i).select("alias"), "documents": docs, "facts": facts, "nodes": nodes, "edges": edges, "links": self.get_entity_links(i)}
