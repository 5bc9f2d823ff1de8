"""A seeded knowledge base of a chosen size, every value a hash of its key: the same on each run and any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents, chunks, entities and facts of each scale.
SCALES = {"tiny": (50, 1_000, 200, 500), "small": (500, 10_000, 2_000, 5_000), "medium": (5_000, 100_000, 20_000, 50_000)}
DOMAINS = ("hr", "engineering", "sales", "legal", "support")
TYPES = ("person", "team", "policy", "product")
WORDS = ("data", "lake", "river", "policy", "course", "team", "plan", "review", "access", "report", "safety", "budget")
#: Shares of statuses among facts, in hundredths, cumulative.
STATUS = ((72, "approved"), (87, "pending"), (97, "draft"), (100, "rejected"))


def generate(spark: SparkSession, scale: str = "small", seed: int = 42) -> dict[str, DataFrame]:
    """documents, chunks, entities, facts, fact_sources, entity_sources, chunk_entities."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale}")
    n_docs, n_chunks, n_entities, n_facts = SCALES[scale]
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(n))
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (draw(salt, len(of)) + 1).cast("int"))

    def phrase(salt: str, n: int) -> Column:
        return F.concat_ws(" ", *(pick(f"{salt}{k}", WORDS) for k in range(n)))

    documents = spark.range(1, n_docs + 1).select("id", F.lit("markdown").alias("source_type"), F.format_string("docs/%d.md", "id").alias("original_path"), F.array(pick("d", DOMAINS)).alias("domains"))
    chunks = spark.range(1, n_chunks + 1).select(F.col("id").alias("chunk_id"), (F.pmod(F.col("id"), F.lit(n_docs)) + 1).alias("doc_id"), F.floor(F.col("id") / n_docs).alias("seq"), phrase("t", 30).alias("search_text"))
    entities = spark.range(1, n_entities + 1).select("id", pick("y", TYPES).alias("type"), F.concat(phrase("e", 2), F.lit(" "), F.col("id").cast("string")).alias("name"), pick("g", DOMAINS).alias("domain"))
    share = draw("s", 100)
    status = F.coalesce(*(F.when(share < top, name) for top, name in STATUS))
    facts = spark.range(1, n_facts + 1).select("id", (draw("a", n_entities) + 1).alias("subject_entity_id"), F.lit("relates_to").alias("predicate"), (draw("b", n_entities) + 1).alias("object_entity_id"), status.alias("status"))
    return {
        "documents": documents, "chunks": chunks, "entities": entities, "facts": facts,
        "fact_sources": facts.select(F.col("id").alias("fact_id"), (draw("f", n_docs) + 1).alias("document_id")),
        "entity_sources": entities.select(F.col("id").alias("entity_id"), (draw("n", n_docs) + 1).alias("document_id")),
        "chunk_entities": spark.range(1, n_chunks + 1).select(F.col("id").alias("chunk_id"), (draw("c", n_entities) + 1).alias("entity_id")),
    }
