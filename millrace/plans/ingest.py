"""Batch ingestion into a versioned store, and the worker that runs it for queued changes."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalize
from millrace.operators import lexical, linking, maintenance, providers, resolve, vectors
from millrace.operators.extract import Pattern, Provider, by_patterns, composite
from millrace.runtime import materialize, numbered
from millrace.sources.files import changed, chunked
from millrace.sources.sink import Store

EMPTY = {
    "documents": "id bigint, path string, source_type string, content_hash string, metadata string",
    "chunks": "chunk_id bigint, doc_id bigint, seq bigint, text string, search_text string, start_offset bigint, end_offset bigint, metadata string",
    "entities": "id bigint, type string, name string, domain string",
    "chunk_entities": "chunk_id bigint, entity_id bigint",
    "entity_sources": "entity_id bigint, document_id bigint",
    "facts": "id bigint, subject_entity_id bigint, predicate string, object_entity_id bigint, status string, weight bigint",
    "fact_sources": "fact_id bigint, document_id bigint",
    "entity_links": "subject_entity_id bigint, target_entity_id bigint, relation_type string, method string, confidence double",
    "entity_aliases": "entity_id bigint, alias string",
    "queue": "id bigint, type string, identity string, event string, ids array<bigint>, status string, attempts int, next_attempt_at bigint",
    "vectors": "chunk_id bigint, version bigint, deleted boolean, embedding array<float>",
}


def tables(store: Store) -> dict[str, DataFrame]:
    have = store.manifest()
    return {n: store.spark.read.parquet(f"{store.root}/{have[n]}") if n in have else store.spark.createDataFrame([], s) for n, s in EMPTY.items()}


def _top(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0] or 0


def without(t: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents at the paths (one column) and what only they held."""
    gone = t["documents"].join(paths.toDF("path").distinct(), "path", "left_semi").select("id")
    out = maintenance.clear_documents(t, gone)
    out["documents"] = t["documents"].join(gone, "id", "left_anti").select(t["documents"].columns)
    return maintenance.cascaded(out)


@dataclass(frozen=True)
class Settings:
    """How documents become knowledge.

    patterns find entities; providers (name, provider) find entities and facts of `domain`; resolving tells entities by
    the tiers of candidate_tiers and groups new names into clusters, else by normalized name alone.
    """

    patterns: list[Pattern] = field(default_factory=list)
    providers: list[tuple[str, Provider]] = field(default_factory=list)
    domain: str = ""
    thresholds: dict[str, float] | None = None
    embedder: providers.Embedder | None = None
    chunking: dict | None = None
    resolving: bool = False
    linkers: linking.Linkers = linking.Linkers(("equals",))


def _entities(t: dict[str, DataFrame], named: DataFrame, resolving: bool) -> tuple[DataFrame, DataFrame]:
    """(entities, homes): all entities with the new ones, and the entity_id of each (type, key, domain) of named."""
    names = named.groupBy("type", "key", "domain").agg(F.min("name").alias("name"))
    known = t["entities"].select("id", "type", "name", "domain").withColumn("key", normalize(F.col("name")))
    same = names.join(known.select("type", "key", "domain", F.col("id").alias("entity_id")).groupBy("type", "key", "domain").agg(F.min("entity_id").alias("entity_id")), ["type", "key", "domain"], "left")
    if resolving:
        mentions = materialize(numbered(same.filter("entity_id is null").drop("entity_id"), "mention_id", 0, ["domain", "type", "key"]), "mentions")
        found = resolve.candidate_tiers(mentions.select("mention_id", "domain", "type", "name"), known.drop("key"), t["entity_aliases"]).select("mention_id", "entity_id")
        open_ = mentions.join(found.filter("entity_id is not null"), "mention_id", "left_anti")
        groups = materialize(resolve.clusters(open_.select(F.col("mention_id").alias("id"), "domain", "type", "name")), "clusters")
        heads = open_.join(groups.filter("id = cluster").select(F.col("id").alias("mention_id"), "canonical"), "mention_id")
        fresh_ = numbered(heads.select("mention_id", "type", "domain", F.col("canonical").alias("name")), "id", _top(t["entities"], "id"), ["mention_id"])
        placed = groups.join(fresh_.select(F.col("mention_id").alias("cluster"), F.col("id").alias("new")), "cluster").select(F.col("id").alias("mention_id"), "new")
        homes = mentions.join(found, "mention_id", "left").join(placed, "mention_id", "left").select("type", "key", "domain", F.coalesce("entity_id", "new").alias("entity_id"))
        homes = homes.unionByName(same.filter("entity_id is not null").select("type", "key", "domain", "entity_id"))
    else:
        fresh_ = numbered(same.filter("entity_id is null").select("type", "key", "domain", "name"), "id", _top(t["entities"], "id"), ["type", "key", "domain"])
        homes = same.filter("entity_id is not null").select("type", "key", "domain", "entity_id").unionByName(fresh_.select("type", "key", "domain", F.col("id").alias("entity_id")))
    entities = t["entities"].unionByName(fresh_.select(t["entities"].columns))
    return entities, materialize(homes, "homes")


def _facts(t: dict[str, DataFrame], found: DataFrame, homes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, fact_sources) with those that providers found; a fact known already gets the new documents as sources."""
    end = lambda s: homes.select(F.col("type").alias(f"{s}_type"), F.col("key").alias(f"{s}_key"), "domain", F.col("entity_id").alias(f"{s}_entity_id"))
    keyed = found.withColumn("subject_key", normalize(F.col("subject_name"))).withColumn("object_key", normalize(F.col("object_name"))).withColumn("subject_type", F.lower("subject_type")).withColumn("object_type", F.lower("object_type"))
    ends = keyed.join(end("subject"), ["subject_type", "subject_key", "domain"]).join(end("object"), ["object_type", "object_key", "domain"])
    key = ["subject_entity_id", "predicate", "object_entity_id"]
    said = materialize(ends.join(chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("document_id")), "id").select(*key, "document_id").distinct(), "said")
    more = numbered(said.select(key).distinct().join(t["facts"].select(key), key, "left_anti"), "id", _top(t["facts"], "id"), key)
    facts = t["facts"].select("id", *key, "status").unionByName(more.select("id", *key, F.lit("approved").alias("status")))
    sources = t["fact_sources"].unionByName(said.join(facts.select("id", *key), key).select(F.col("id").alias("fact_id"), "document_id")).distinct()
    weights = sources.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("weight"))
    return facts.join(weights, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0))).select(t["facts"].columns), sources


def ingest(store: Store, docs: DataFrame, settings: Settings) -> int:
    """New version of the store with docs (of millrace.sources.files) in it; how many documents were new or changed.

    Unchanged contents are passed over; a changed document first loses all that came from it. Found names are resolved
    to entities, facts between them are stored with their documents, vectors follow, and each document with entities
    gets an entity:link task. All tables are published by one manifest.
    """
    t = tables(store)
    new = materialize(changed(docs, t["documents"]), "changed")
    n = new.count()
    if not n:
        return 0
    again = not new.join(t["documents"].select("path"), "path", "left_semi").isEmpty()
    if again:
        t = without(t, new.select("path"))
    rows = materialize(numbered(new.select("path", "source_type", "content_hash", "metadata"), "id", _top(t["documents"], "id"), ["path"]), "documents")
    cut = chunked(new, settings.chunking).join(rows.select("path", F.col("id").alias("doc_id")), "path").drop("path")
    chunks = materialize(numbered(cut, "chunk_id", _top(t["chunks"], "chunk_id"), ["doc_id", "seq"]), "chunks")
    out = {"documents": t["documents"].unionByName(rows.select(t["documents"].columns)), "chunks": t["chunks"].unionByName(chunks.select(t["chunks"].columns))}
    names, told = [], None
    if settings.patterns:
        names.append(by_patterns(chunks, settings.patterns).select("id", "name", "type", "domain"))
    if settings.providers:
        entities, told = composite(chunks, settings.providers, settings.domain, settings.thresholds, "metadata")
        names.append(entities.select("id", "name", F.lower("type").alias("type"), "domain"))
    if names:
        named = materialize(reduce(DataFrame.unionByName, names).withColumn("key", normalize(F.col("name"))), "found")
        entities, homes = _entities(t, named, settings.resolving)
        hits = named.join(homes, ["type", "key", "domain"]).select(F.col("id").alias("chunk_id"), "entity_id").distinct()
        sources = materialize(hits.join(chunks.select("chunk_id", F.col("doc_id").alias("document_id")), "chunk_id").select("entity_id", "document_id").distinct(), "sources")
        out |= {"entities": entities, "chunk_entities": t["chunk_entities"].unionByName(hits), "entity_sources": t["entity_sources"].unionByName(sources)}
        if told is not None:
            out["facts"], out["fact_sources"] = _facts(t, told, homes, chunks)
        ask = sources.groupBy("document_id").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
        due = ask.select(F.lit("entity:link").alias("type"), F.col("document_id").cast("string").alias("identity"), F.lit("").alias("event"), "ids", F.lit(0).cast("bigint").alias("at"))
        out["queue"] = queued(t["queue"], due)
    if settings.embedder:
        version = _top(t["vectors"], "version") + 1
        made = providers.embed(chunks, settings.embedder).select("chunk_id", F.lit(version).cast("bigint").alias("version"), F.lit(False).alias("deleted"), "embedding")
        live = t["vectors"].join(out["chunks"], "chunk_id", "left_semi")
        out["vectors"] = live.unionByName(made)
    store.commit({**(t if again else {}), **out})
    return n


def queued(queue: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after events (type, identity, event, ids, at): a key's task is renewed, its ids united with those that
    waited; all others stay."""
    old = queue.filter("status <> 'done'").select("type", "identity", "event", "ids", F.lit(-1).cast("bigint").alias("at"))
    touched = events.select("type", "identity").distinct()
    both = events.select("type", "identity", "event", "ids", "at").unionByName(old.join(touched, ["type", "identity"], "left_semi").select("type", "identity", "event", "ids", "at"))
    fresh_ = maintenance.enqueue(both.withColumn("order", F.lit(0)))
    kept = queue.join(touched, ["type", "identity"], "left_anti").select(queue.columns)
    return kept.unionByName(numbered(fresh_, "id", _top(queue, "id"), ["type", "identity"]).select(*(F.col(n).cast(t) for n, t in queue.dtypes)))


def enqueue(store: Store, events: DataFrame) -> int:
    """New version of the store with events (type, identity, event, at) in its queue."""
    more = events if "ids" in events.columns else events.withColumn("ids", F.array().cast("array<bigint>"))
    return store.commit({"queue": queued(tables(store)["queue"], more)})


def fill(store: Store, more: dict[str, DataFrame], embedder: providers.Embedder | None = None) -> int:
    """Bulk load: the given tables take the place of the store's, with postings and vectors made anew from the chunks,
    in one version. No duplicate is looked for and nothing is linked."""
    out = dict(more)
    chunks = out.get("chunks", tables(store)["chunks"])
    out["postings"] = lexical.postings(chunks)
    if embedder:
        out["vectors"] = vectors.rebuilt(providers.embed(chunks, embedder).select("chunk_id", "embedding"))
    return store.commit(out)


def remove(store: Store, paths: DataFrame) -> int:
    """New version of the store without the documents at the paths."""
    return store.commit(without(tables(store), paths))


def link(store: Store, ids: DataFrame, settings: Settings) -> None:
    """Links and merges of pairs that touch the entities of the one-column table ids."""
    t = tables(store)
    links, merges = linking.build_links(t["entities"], t["entity_links"], t["entity_sources"], settings.linkers, ids)
    out, n = linking.merged({**t, "entity_links": links}, merges)
    store.commit(out if n else {"entity_links": links})


def collect(store: Store) -> int:
    """One garbage collection; the new version, or the last one if nothing is garbage."""
    t = tables(store)
    dead = (maintenance.orphan_entities(t["entities"], t["entity_sources"], t["facts"]), maintenance.orphan_facts(t["facts"], t["fact_sources"]), maintenance.orphan_documents(t["documents"], t["chunks"], t["entity_sources"], t["fact_sources"]))
    if all(df.isEmpty() for df in dead):
        return max(store.versions(), default=0)
    return store.commit(maintenance.collect_garbage(t))


def run_once(store: Store, disk: DataFrame, settings: Settings, now: int) -> dict[str, int]:
    """One worker cycle: at most 100 due tasks are claimed and run by type, then garbage is collected.

    doc:index and doc:delete tasks name paths of disk (of millrace.sources.files), entity:link tasks a document and the
    entities in their ids. Tasks of a type run together; if that fails, each runs alone, so that one broken task fails
    by itself: it is tried again later, or is an error at its last attempt. Done deletions leave the queue. A task of
    an unknown type stays claimed. What a task enqueued meanwhile is kept.
    """
    spark = store.spark
    queue = tables(store)["queue"]
    claimed = maintenance.claim(queue, now).select("id", "type", "identity", "ids").collect()  # 100 at most
    if claimed:
        mine = spark.createDataFrame([(r["id"],) for r in claimed], "id bigint")
        mark = queue.join(F.broadcast(mine.withColumn("_m", F.lit(True))), "id", "left")
        store.commit({"queue": mark.withColumn("status", F.when(F.col("_m"), "processing").otherwise(F.col("status"))).select(queue.columns)})

    def run(kind: str, rows: list) -> None:
        paths = spark.createDataFrame([(r["identity"],) for r in rows], "path string")
        if kind == "doc:index":
            found = disk.join(F.broadcast(paths), "path", "left_semi")
            if (have := found.count()) < len({r["identity"] for r in rows}):
                raise FileNotFoundError(f"{len(rows) - have} of {len(rows)} documents are not on disk")
            ingest(store, found, settings)
        elif kind == "doc:delete":
            remove(store, paths)
        else:
            ids = sorted({i for r in rows for i in r["ids"]})
            link(store, spark.createDataFrame([(i,) for i in ids], "id bigint"), settings)

    done, broken = [], []
    for kind in ("doc:index", "doc:delete", "entity:link"):
        todo = [[r for r in claimed if r["type"] == kind]]
        while todo:
            rows = todo.pop()
            if not rows:
                continue
            try:
                run(kind, rows)
                done += [r["id"] for r in rows]
            except Exception as e:  # noqa: BLE001 - a failed task is recorded in the queue and never ends the cycle
                if len(rows) > 1:
                    todo += [[r] for r in rows]
                else:
                    warnings.warn(f"{kind} {rows[0]['identity']} failed: {e}", stacklevel=2)
                    broken += [rows[0]["id"]]
    if claimed:
        table = lambda x: spark.createDataFrame([(i,) for i in x], "id bigint")
        store.commit({"queue": maintenance.finished(tables(store)["queue"], table(done), table(broken), now)})
    collect(store)
    return {"done": len(done), "failed": len(broken), "unknown": len(claimed) - len(done) - len(broken)}


def work(store: Store, disk: DataFrame, settings: Settings, now: int = 0) -> dict[str, int]:
    """Reconciles a source's documents on disk with the store: what changed or went is enqueued, then worker cycles run
    until no task is due."""
    hashes = disk.select("path", F.sha2("content", 256).alias("hash"))
    t = tables(store)
    known = t["documents"].select("path", F.col("content_hash").alias("hash"))
    todo = materialize(maintenance.reconcile(hashes, known, t["queue"].select("type", "identity", "status")), "todo")
    kinds = {"index": "doc:index", "delete": "doc:delete"}
    events = todo.filter(F.col("action").isin(*kinds)).select(F.concat(F.lit("doc:"), F.col("action")).alias("type"), F.col("path").alias("identity"), F.lit("").alias("event"), F.lit(now).cast("bigint").alias("at"))
    counts = {r["action"]: r["n"] for r in todo.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if any(counts.get(k) for k in kinds):
        enqueue(store, events)
    while tables(store)["queue"].filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).limit(1).count():
        run_once(store, disk, settings, now)
    return {"indexed": counts.get("index", 0), "deleted": counts.get("delete", 0)}
