"""The task queue, reconciliation, garbage collection and cascades, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, BACKOFF, BATCH = 3, 30, 100


def enqueue(events: DataFrame) -> DataFrame:
    """(type, identity, event, ids, status, attempts, next_attempt_at): the queue after all events, by key.

    events has (type, identity, event, at, order) and optionally ids. The last event of a key gives its payload and
    time and resets attempts; ids of all events are united. Minima and maxima combine before the shuffle.
    """
    rows = events if "ids" in events.columns else events.withColumn("ids", F.array().cast("array<bigint>"))
    ids = rows.groupBy("type", "identity").agg(F.max_by("event", F.struct("at", "order")).alias("event"), F.max("at").alias("next_attempt_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return ids.select("type", "identity", "event", "ids", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "next_attempt_at")


def claim(tasks: DataFrame, now: int, n: int = BATCH) -> DataFrame:
    """The n oldest pending tasks that are due, by time and id, now processing."""
    due = tasks.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    return due.orderBy("next_attempt_at", "id").limit(n).withColumn("status", F.lit("processing"))


def failed(tasks: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Tasks after a failure: an error at the last attempt, else pending again after 30, 60, ... seconds."""
    after = F.col("attempts") + 1
    wait = BACKOFF * F.pow(F.lit(2.0), F.col("attempts"))
    return tasks.withColumn("status", F.when(after >= max_attempts, "error").otherwise("pending")).withColumn("next_attempt_at", F.when(after >= max_attempts, F.col("next_attempt_at")).otherwise((now + wait).cast("bigint"))).withColumn("attempts", after)


def recovered(tasks: DataFrame) -> DataFrame:
    """Processing tasks of a worker that died, pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def reset_errors(tasks: DataFrame, prefix: str = "", now: int = 0) -> DataFrame:
    """Failed tasks whose identity begins with prefix, pending from the start."""
    hit = (F.col("status") == "error") & F.startswith("identity", F.lit(prefix))
    return tasks.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts"))).withColumn("next_attempt_at", F.when(hit, now).otherwise(F.col("next_attempt_at"))).withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def listed(tasks: DataFrame, source: str = "", status: str = "") -> DataFrame:
    """Tasks by id; a source keeps those whose identity begins with it, a status those that have it."""
    out = tasks.filter(F.startswith("identity", F.lit(source))) if source else tasks
    return (out.filter(F.col("status") == status) if status else out).orderBy("id")


def finished(tasks: DataFrame, done: DataFrame, broken: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The queue after tasks ran: those of the ids in done are done, deletions among them gone; those of the ids in
    broken have failed once more; the rest stay as they are."""
    marked = tasks.join(done.toDF("id").distinct().withColumn("_did", F.lit(True)), "id", "left").join(broken.toDF("id").distinct().withColumn("_broke", F.lit(True)), "id", "left")
    left = marked.filter(~(F.col("_did").isNotNull() & (F.col("type") == "doc:delete")))
    again = failed(left.filter("_broke"), now, max_attempts)
    rest = left.filter("_broke is null").withColumn("status", F.when(F.col("_did"), "done").otherwise(F.col("status")))
    return rest.unionByName(again.select(rest.columns)).select(tasks.columns)


def reconcile(disk: DataFrame, documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """(path, action): index, delete, unchanged or cancel_delete for each path on disk or known.

    disk has (path, hash), documents (path, hash), tasks (type, identity, status). A file that is as known cancels a
    pending delete; a known or queued path that is gone is deleted.
    """
    d = disk.select("path", F.col("hash").alias("now"))
    k = documents.select("path", F.col("hash").alias("known"))
    queued = tasks.filter(F.col("type").isin("doc:index", "doc:delete")).groupBy(F.col("identity").alias("path")).agg(F.max((F.col("type") == "doc:delete") & (F.col("status") == "pending")).alias("doomed"), F.max(F.col("type") == "doc:index").alias("awaited"))
    all_ = d.join(k, "path", "full_outer").join(queued, "path", "full_outer")
    same = F.col("now") == F.col("known")
    action = F.when(F.col("now").isNull(), F.when(F.col("known").isNotNull() | F.coalesce("awaited", F.lit(False)), "delete")).when(F.coalesce(same, F.lit(False)), F.when(F.coalesce("doomed", F.lit(False)), "cancel_delete").otherwise("unchanged")).otherwise("index")
    return all_.select("path", action.alias("action")).filter(F.col("action").isNotNull())


def orphan_entities(entities: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities without a source and without a fact, apart from those of type EntityType."""
    used = facts.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id"))
    free = entities.filter(F.col("type") != "EntityType").join(sources.select(F.col("entity_id").alias("id")), "id", "left_anti")
    return free.join(used, "id", "left_anti")


def orphan_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts without a source that nobody approved."""
    return facts.filter(F.col("status") != "approved").join(sources.select(F.col("fact_id").alias("id")), "id", "left_anti")


def orphan_documents(documents: DataFrame, chunks: DataFrame, entity_sources: DataFrame, fact_sources: DataFrame) -> DataFrame:
    """Documents that nothing refers to."""
    out = documents
    for df, column in ((chunks, "doc_id"), (entity_sources, "document_id"), (fact_sources, "document_id")):
        out = out.join(df.select(F.col(column).alias("id")), "id", "left_anti")
    return out


def collect_garbage(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One cycle: entities, then facts, then documents, each judged on what the step before left."""
    out = dict(t)
    gone = lambda df, dead: df.join(dead.select("id"), "id", "left_anti")
    out["entities"] = gone(t["entities"], orphan_entities(t["entities"], t["entity_sources"], t["facts"]))
    out["facts"] = gone(t["facts"], orphan_facts(t["facts"], t["fact_sources"]))
    out["documents"] = gone(t["documents"], orphan_documents(t["documents"], t["chunks"], t["entity_sources"], t["fact_sources"]))
    return cascaded(out)


def cascaded(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that refer to a missing document, chunk or entity go with it; facts stay without their entities."""
    out = dict(t)

    def only(name: str, column: str, parent: str, key: str = "id") -> None:
        if name in out and parent in out:
            out[name] = out[name].join(out[parent].select(F.col(key).alias(column)), column, "left_semi").select(out[name].columns)

    only("chunks", "doc_id", "documents")
    only("chunk_entities", "chunk_id", "chunks", "chunk_id")
    for name in ("chunk_entities", "entity_sources", "entity_aliases"):
        only(name, "entity_id", "entities")
    for name in ("entity_sources", "fact_sources"):
        only(name, "document_id", "documents")
    only("fact_sources", "fact_id", "facts")
    for column in ("subject_entity_id", "target_entity_id"):
        only("entity_links", column, "entities")
    return out


def clear_documents(t: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the content of documents (one column of ids): their sources, the facts they alone held
    (approved ones too), their chunks, and the entities among their own that no source and no fact holds any more.
    Weights follow the sources that are left; the documents' own rows stay."""
    out, docs = dict(t), gone.toDF("document_id").distinct()
    touched = lambda name, column: t[name].join(docs, "document_id", "left_semi").select(F.col(column).alias("id")).distinct()
    touched_facts, touched_entities = touched("fact_sources", "fact_id"), touched("entity_sources", "entity_id")
    for name in ("fact_sources", "entity_sources"):
        out[name] = t[name].join(docs, "document_id", "left_anti").select(t[name].columns)
    dead = touched_facts.join(out["fact_sources"].select(F.col("fact_id").alias("id")), "id", "left_anti")
    facts = t["facts"].join(dead, "id", "left_anti")
    if "weight" in facts.columns:
        weight = out["fact_sources"].groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("__w"))
        again = facts.join(touched_facts.withColumn("__t", F.lit(True)), "id", "left").join(weight, "id", "left")
        facts = again.withColumn("weight", F.when(F.col("__t"), F.coalesce("__w", F.lit(0))).otherwise(F.col("weight")))
    out["facts"] = facts.select(t["facts"].columns)
    out["chunks"] = t["chunks"].join(docs.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti").select(t["chunks"].columns)
    lost = orphan_entities(t["entities"].join(touched_entities, "id", "left_semi"), out["entity_sources"], out["facts"])
    out["entities"] = t["entities"].join(lost.select("id"), "id", "left_anti").select(t["entities"].columns)
    return cascaded(out)


def clear_document(t: dict[str, DataFrame], doc: int) -> dict[str, DataFrame]:
    """clear_documents of one document."""
    return clear_documents(t, t["chunks"].sparkSession.createDataFrame([(doc,)], "document_id bigint"))


def under_root(path: str, root: str):
    """Whether a path column lies inside a folder."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))


def cleared_source(documents: DataFrame, root: str) -> DataFrame:
    return documents.filter(~under_root("original_path", root))


def debounced(events: DataFrame, quiet: int = 30, time_col: str = "ts", with_paths: bool = True) -> DataFrame:
    """(start, end, n, and with with_paths the distinct paths): batches of changes with no gap above `quiet` seconds.

    A stream uses session windows. A table is first combined by cells of `quiet` seconds, in each of which all changes
    belong together, map-side; only the cells, whose number the time span bounds, are then ordered in one task.
    """
    paths = [F.array_sort(F.collect_set("path")).alias("paths")] if with_paths else []
    if events.isStreaming:
        window = F.session_window(time_col, f"{quiet} seconds")
        return events.groupBy(window).agg(F.count("*").alias("n"), *paths).select("session_window.start", "session_window.end", "n", *(["paths"] if with_paths else []))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sets = [F.collect_set("path").alias("paths")] if with_paths else []
    known = events.filter(F.col(time_col).isNotNull())
    cells = known.groupBy(F.floor(micros(time_col) / F.lit(quiet * 1_000_000)).alias("cell")).agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"), F.count("*").alias("n"), *sets)
    order = Window.orderBy("cell")
    apart = F.coalesce((micros("lo") - F.lag(micros("hi")).over(order) > quiet * 1_000_000).cast("int"), F.lit(1))
    batch = cells.withColumn("apart", apart).withColumn("batch", F.sum("apart").over(order))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths")] if with_paths else []
    out = batch.groupBy("batch").agg(F.min("lo").alias("start"), (F.max("hi") + F.expr(f"interval {quiet} seconds")).alias("end"), F.sum("n").alias("n"), *merged)
    return out.drop("batch")


def latest_tasks(tasks: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("type", "identity").orderBy(F.desc("id")))
    return tasks.withColumn("__r", rank).filter("__r = 1").drop("__r")
