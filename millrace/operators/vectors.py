"""Vector search and the versioned vector table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import bound_batches

OVERFETCH = 3


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(chunk_id, distance) of the k rows of least squared L2 distance in double precision, ties by id.

    Each Arrow batch is reduced to its best k by NumPy before anything moves; the rest is a top-k over those. Null
    vectors are passed over; a vector of another length or a k below 1 raises.
    """
    if k < 1:
        raise ValueError("k must be positive")
    bound_batches(vectors.sparkSession)
    q = np.asarray(query, float)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat) != batch.num_rows * len(q):
                raise ValueError("a vector's length differs from the query's")
            distance = ((flat.reshape(-1, len(q)) - q) ** 2).sum(axis=1)
            ids = batch.column(0).to_numpy()
            keep = np.lexsort((ids, distance))[:k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(distance[keep])], names=["chunk_id", "distance"])

    rows = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col))
    return rows.mapInArrow(best, "chunk_id bigint, distance double").orderBy("distance", "chunk_id").limit(k)


def squared_l2(vector: Column, query: Sequence[float]) -> Column:
    """The distance as a built-in expression."""
    pairs = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def semantic(vectors: DataFrame, chunks: DataFrame, query: Sequence[float], k: int, domain: str | None = None, prefilter: bool = False) -> DataFrame:
    """(chunk_id, distance) of the nearest known chunks.

    k times OVERFETCH vectors are fetched, those without a chunk fall out, then chunks of other domains (both sides
    normalized), then all beyond k; so fewer than k rows may remain. With prefilter the domain is applied first and the
    result is exact. A k below 1 becomes 20.
    """
    k = k if k > 0 else 20
    known = chunks.select("chunk_id", "domains")
    if domain:
        name = " ".join(domain.split()).lower()
        known = known.withColumn("ok", F.exists("domains", lambda d: F.lower(F.trim(F.regexp_replace(d, r"\s+", " "))) == name))
    else:
        known = known.withColumn("ok", F.lit(True))
    if prefilter:
        allowed = vectors.join(known.filter("ok"), "chunk_id", "left_semi")
        return top_k(allowed, query, k)
    near = top_k(vectors, query, k * OVERFETCH)
    return known.join(F.broadcast(near), "chunk_id").filter("ok").select("chunk_id", "distance").orderBy("distance", "chunk_id").limit(k)


def latest(log: DataFrame) -> DataFrame:
    """Live vectors of a log (chunk_id, version, deleted, embedding): the freshest row of each id, unless deleted."""
    newest = log.groupBy("chunk_id").agg(F.max_by(F.struct("deleted", "embedding"), "version").alias("row"), F.max("version").alias("version"))
    return newest.filter(~F.col("row.deleted")).select("chunk_id", "version", F.col("row.embedding").alias("embedding"))


def stale_share(log: DataFrame) -> DataFrame:
    """(rows, stale, compact): superseded or deleted rows, and whether they pass 30 % of the log."""
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("version")))
    marked = log.select(((rank > 1) | F.col("deleted")).alias("stale"))
    return marked.agg(F.count("*").alias("rows"), F.count_if("stale").alias("stale")).withColumn("compact", F.col("stale") * 100 > F.col("rows") * 30)


def compacted(log: DataFrame) -> DataFrame:
    """The log without superseded and deleted rows, which is also what a reopened index starts from; a store publishes
    it as one version, so readers see the old log or this one."""
    return latest(log).select("chunk_id", "version", F.lit(False).alias("deleted"), "embedding")


def maybe_compacted(log: DataFrame) -> tuple[DataFrame, bool]:
    """The compacted log where stale rows pass 30 % of it, else the log itself; and which of the two."""
    due = bool(stale_share(log).first()["compact"])
    return (compacted(log) if due else log), due


def ids(log: DataFrame) -> DataFrame:
    """Ids of live vectors, each once; their number is its count()."""
    return latest(log).select("chunk_id")


def rebuilt(rows: DataFrame) -> DataFrame:
    """A new log of (chunk_id, embedding) rows alone, all of the first version; of repeated ids one row stays."""
    once = rows.groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))
    return once.select("chunk_id", F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("deleted"), "embedding")


def appended(log: DataFrame, rows: DataFrame, deleted: bool = False) -> DataFrame:
    """The log with rows (chunk_id, embedding) added, or deletions of (chunk_id) rows, one version above the last."""
    top = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    vector = F.lit(None).cast(log.schema["embedding"].dataType) if deleted else F.col("embedding").cast(log.schema["embedding"].dataType)
    more = rows.crossJoin(F.broadcast(top)).select("chunk_id", (F.col("top") + 1).alias("version"), F.lit(deleted).alias("deleted"), vector.alias("embedding"))
    return log.select("chunk_id", "version", "deleted", "embedding").unionByName(more)


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of vectors without a chunk."""
    return vectors.join(chunks, "chunk_id", "left_anti").select("chunk_id")


def missing(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of chunks without a vector, to embed again."""
    return chunks.join(vectors, "chunk_id", "left_anti").select("chunk_id")
