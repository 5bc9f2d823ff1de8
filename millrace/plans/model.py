"""The knowledge model over the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalize
from millrace.operators.chunking import fixed_chunks
from millrace.runtime import spread

#: Where each kind of entity's ids begin.
REGION, NATION, SUPPLIER, CUSTOMER, PART = 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000, 5_000_000_000
#: Key numbers within which parts of one name are linked.
LINK_REACH = 40


class Model:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df

    def documents(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", (F.col("quality") == 1).alias("is_official"), (F.col("toxic") == 1).alias("is_deprecated"))
        docs = self.table("documents").join(labels, "doc_id", "left")
        return docs.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("source_type"),
            F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("original_path"),
            F.array("lang").alias("domains"),
            F.col("text").alias("content"),
            F.sha2("text", 256).alias("content_hash"),
            F.coalesce("is_official", F.lit(False)).alias("is_official"),
            F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"),
            (F.lit(1704067200) + F.pmod(F.col("doc_id"), F.lit(365)) * 86400).cast("bigint").alias("updated_at"),
        )

    def chunks(self) -> DataFrame:
        cut = fixed_chunks(self.table("documents"), "doc_id", "text", keep=["lang"])
        number = (F.col("id") * 1000 + F.col("seq")).alias("chunk_id")
        return cut.select(F.col("id").alias("doc_id"), number, "seq", F.col("text").alias("search_text"), "start_offset", "end_offset", F.array("lang").alias("domains"))

    def vectors(self) -> DataFrame:
        """Each embedding under the first chunk of the document with its number, and beyond the documents under none."""
        return self.table("embeddings").select((F.col("vec_id") * 1000).alias("chunk_id"), "embedding", "label")

    def entities(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        home = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        at = lambda base, key: (F.lit(base) + F.col(key)).cast("bigint").alias("id")
        kind = lambda k, n, d: (F.lit(k).alias("type"), F.col(n).alias("name"), F.col(d).alias("domain"))
        names = F.broadcast(nation.select("n_nationkey", "n_name"))
        return (
            region.select(at(REGION, "r_regionkey"), *kind("region", "r_name", "r_name"))
            .unionByName(home.select(at(NATION, "n_nationkey"), *kind("nation", "n_name", "r_name")))
            .unionByName(self.table("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(at(SUPPLIER, "s_suppkey"), *kind("supplier", "s_name", "n_name")))
            .unionByName(self.table("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(at(CUSTOMER, "c_custkey"), *kind("customer", "c_name", "n_name")))
            .unionByName(self.table("part").select(at(PART, "p_partkey"), *kind("part", "p_name", "p_brand")))
        )

    def facts(self) -> DataFrame:
        """part_of and located_in; customers of a segment below BUILDING are drafts, so statuses differ."""
        row = lambda s, sk, p, o, ok, status: ((F.lit(s) + F.col(sk)).cast("bigint").alias("subject_entity_id"), F.lit(p).alias("predicate"), (F.lit(o) + F.col(ok)).cast("bigint").alias("object_entity_id"), status.alias("status"))
        ok = F.lit("approved")
        facts = (
            self.table("nation").select(*row(NATION, "n_nationkey", "part_of", REGION, "n_regionkey", ok))
            .unionByName(self.table("supplier").select(*row(SUPPLIER, "s_suppkey", "located_in", NATION, "s_nationkey", ok)))
            .unionByName(self.table("customer").select(*row(CUSTOMER, "c_custkey", "located_in", NATION, "c_nationkey", F.when(F.col("c_mktsegment") <= "AUTOMOBILE", "draft").otherwise("approved"))))
        )
        return facts.withColumn("id", F.col("subject_entity_id")).withColumn("domain", F.lit(""))

    def fact_sources(self) -> DataFrame:
        """One source for each order of a customer's fact."""
        return self.table("orders").select((F.lit(CUSTOMER) + F.col("o_custkey")).cast("bigint").alias("fact_id"), F.col("o_orderkey").alias("document_id"))

    def links(self) -> DataFrame:
        """Parts of one name and at most LINK_REACH keys apart are linked, in both directions.

        Parts meet by name and cell of LINK_REACH keys, each with those of its own cell and the next: the rows that meet
        grow with the parts, however many have one name.
        """
        part = self.table("part").select((F.lit(PART) + F.col("p_partkey")).cast("bigint").alias("id"), normalize(F.col("p_name")).alias("k"))
        cell = F.floor(F.col("id") / F.lit(LINK_REACH))
        a = part.select(F.col("id").alias("a"), "k", F.explode(F.array(cell, cell + 1)).alias("cell"))
        b = part.select(F.col("id").alias("b"), "k", cell.alias("cell"))
        # small files may hold many parts, so a table's size does not decide to broadcast it
        near = a.join(b.hint("merge"), ["k", "cell"]).filter((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + LINK_REACH))
        ends = lambda s, t: F.struct(F.col(s).alias("subject_entity_id"), F.col(t).alias("target_entity_id"))
        both = near.select(F.inline(F.array(ends("a", "b"), ends("b", "a"))))
        return both.withColumn("relation_type", F.lit("same_as")).withColumn("method", F.lit("equals")).withColumn("confidence", F.lit(0.9))

    def events(self) -> DataFrame:
        """Queue events: type, identity, payload and the second they come at."""
        rows = self.table("events")
        return rows.select("event_id", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("identity"), F.col("props").alias("event"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


#: The same tables for DuckDB; each query's text begins with the ones it needs.
SQL = {
    "k_docs": r"""k_docs AS (SELECT d.doc_id AS id, source AS source_type, 'docs/' || source || '/' || d.doc_id AS original_path, lang, text AS content,
  sha256(text) AS content_hash, coalesce(quality = 1, false) AS is_official, coalesce(toxic = 1, false) AS is_deprecated,
  (1704067200 + d.doc_id % 365 * 86400)::BIGINT AS updated_at FROM documents d LEFT JOIN labels USING (doc_id))""",
    "k_chunks": r"""k_chunks AS (SELECT doc_id * 1000 + k AS chunk_id, doc_id, k AS seq, lang, substr(text, k * 900 + 1, 1000) AS search_text,
  octet_length(encode(substr(text, 1, k * 900)))::BIGINT AS start_offset, octet_length(encode(substr(text, 1, least(k * 900 + 1000, length(text)))))::BIGINT AS end_offset
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 900.0))::BIGINT + 1)) AS k FROM documents WHERE length(trim(text)) > 0))""",
    "k_tokens": r"""k_tokens AS (SELECT chunk_id, doc_id, lang, regexp_extract_all(strip_accents(lower(search_text)), '[\pL\pN]+') AS t FROM k_chunks)""",
    "k_entities": r"""k_entities AS (SELECT 1000000000 + r_regionkey AS id, 'region' AS type, r_name AS name, r_name AS domain FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, 'nation', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 3000000000 + s_suppkey, 'supplier', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 4000000000 + c_custkey, 'customer', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 5000000000 + p_partkey, 'part', p_name, p_brand FROM part)""",
    "k_facts": r"""k_facts AS (SELECT 2000000000 + n_nationkey AS s, 'part_of' AS predicate, 1000000000 + n_regionkey AS o, 'approved' AS status FROM nation
  UNION ALL SELECT 3000000000 + s_suppkey, 'located_in', 2000000000 + s_nationkey, 'approved' FROM supplier
  UNION ALL SELECT 4000000000 + c_custkey, 'located_in', 2000000000 + c_nationkey, CASE WHEN c_mktsegment <= 'AUTOMOBILE' THEN 'draft' ELSE 'approved' END FROM customer)""",
    "k_links": r"""k_links AS (SELECT 5000000000 + a.p_partkey AS s, 5000000000 + b.p_partkey AS o FROM part a JOIN part b
  ON lower(a.p_name) = lower(b.p_name) AND b.p_partkey <> a.p_partkey AND abs(b.p_partkey - a.p_partkey) <= 40)""",
    "k_edges": r"""k_edges AS (SELECT s, o, predicate AS relation, 'fact' AS kind FROM k_facts WHERE status = 'approved' UNION ALL SELECT s, o, 'same_as', 'link' FROM k_links)""",
    "k_events": r"""k_events AS (SELECT event_id, event_type AS type, user_id::VARCHAR AS identity, props AS event, floor(epoch(ts))::BIGINT AS due FROM events)""",
}


def with_(*names: str, recursive: bool = False, more: str = "") -> str:
    parts = ",\n".join([SQL[n] for n in names] + ([more] if more else []))
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n"
