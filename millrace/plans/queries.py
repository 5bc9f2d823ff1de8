"""Registered queries of the core engine over the driver's tables, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import catalog, chunking, extract, fusion, graph, lexical, linking, maintenance, resolve, search, vectors
from millrace.plans.model import CUSTOMER, NATION, PART, REGION, Model, with_
from millrace.runtime import discard, materialize
from millrace.sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = '"of the" OR keit*'
AS_OF = 1735689600


def query(sql: str | None = None):
    """Registers a function of a Model under its own name, with its DuckDB text."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _query_vector(m: Model) -> list[float]:
    return list(m.table("embeddings").filter("vec_id = 0").select("embedding").first()[0])


# ---- chunks and search -------------------------------------------------------------------------------------------


@query(with_("k_chunks") + "SELECT chunk_id, doc_id, seq, start_offset, end_offset, sha256(search_text) AS text_hash FROM k_chunks")
def chunk_fixed(m: Model) -> DataFrame:
    return m.chunks().select("chunk_id", "doc_id", F.col("seq").cast("bigint").alias("seq"), "start_offset", "end_offset", F.sha2("search_text", 256).alias("text_hash"))


@query(with_("k_chunks", "k_tokens") + "SELECT term, id, count(*) AS tf FROM (SELECT chunk_id AS id, unnest(t) AS term FROM k_tokens) GROUP BY ALL")
def postings_tf(m: Model) -> DataFrame:
    return lexical.postings(m.chunks())


_BM25 = r"""k_tf AS (SELECT chunk_id, doc_id, lang, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS a,
  len(list_filter(t, lambda x: starts_with(x, 'keit'))) AS b FROM k_tokens),
k_stat AS (SELECT count(*) AS n, avg(dl) AS avg, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM k_tf),
k_bm AS (SELECT chunk_id, doc_id, lang, -(CASE WHEN ln((n - na + 0.5) / (na + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - na + 0.5) / (na + 0.5)) END * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avg))
  + CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nb + 0.5) / (nb + 0.5)) END * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avg))) AS bm25
  FROM k_tf, k_stat WHERE a > 0 OR b > 0)"""


@query(with_("k_chunks", "k_tokens", more=_BM25) + "SELECT chunk_id, round(bm25, 6) AS bm25 FROM k_bm ORDER BY k_bm.bm25, chunk_id LIMIT 50")
def bm25_topk(m: Model) -> DataFrame:
    return lexical.search(m.chunks(), QUERY, 50).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(with_("k_chunks", "k_tokens", more=_BM25) + "SELECT chunk_id, round(bm25, 6) AS bm25 FROM k_bm WHERE lang = 'de' ORDER BY k_bm.bm25, chunk_id LIMIT 20")
def bm25_domain_filter(m: Model) -> DataFrame:
    return lexical.search(m.chunks(), QUERY, 500, domain=" DE ").select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(with_("k_chunks", "k_tokens", more=_BM25) + "SELECT chunk_id, round(bm25, 6) AS bm25 FROM k_bm")
def bm25_all(m: Model) -> DataFrame:
    return lexical.scored(m.chunks(), QUERY).select("chunk_id", F.round("bm25", 6).alias("bm25"))


_NEAR = """k_near AS (SELECT vec_id * 1000 AS chunk_id, label, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))) AS distance
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query(with_(more=_NEAR) + "SELECT chunk_id, round(distance, 6) AS distance FROM k_near ORDER BY k_near.distance, chunk_id LIMIT 25")
def vector_topk_l2(m: Model) -> DataFrame:
    return vectors.top_k(m.vectors(), _query_vector(m), 25).select("chunk_id", F.round("distance", 6).alias("distance"))


_LEG = _NEAR + ", k_pool AS (SELECT * FROM k_near ORDER BY distance, chunk_id LIMIT 60), k_sem AS (SELECT chunk_id, distance FROM k_pool JOIN k_chunks USING (chunk_id) WHERE lang = 'en' ORDER BY distance, chunk_id LIMIT 20)"


@query(with_("k_chunks", more=_LEG) + "SELECT chunk_id, round(distance, 6) AS distance FROM k_sem")
def vector_topk_overfetch(m: Model) -> DataFrame:
    return vectors.semantic(m.vectors(), m.chunks(), _query_vector(m), 20, domain="EN").select("chunk_id", F.round("distance", 6).alias("distance"))


@query(with_("k_chunks", more=_NEAR) + "SELECT chunk_id, round(distance, 6) AS distance FROM k_near JOIN k_chunks USING (chunk_id) WHERE lang = 'fr' ORDER BY k_near.distance, chunk_id LIMIT 20")
def vector_topk_prefilter(m: Model) -> DataFrame:
    return vectors.semantic(m.vectors(), m.chunks(), _query_vector(m), 20, domain="fr", prefilter=True).select("chunk_id", F.round("distance", 6).alias("distance"))


_FUSED = (
    _BM25
    + ", k_lex AS (SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25, chunk_id) AS lr FROM k_bm QUALIFY lr <= 50), "
    + _NEAR
    + """, k_pool AS (SELECT * FROM k_near ORDER BY distance, chunk_id LIMIT 150),
k_sem AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS sr FROM k_pool JOIN k_chunks USING (chunk_id) QUALIFY sr <= 50),
k_both AS (SELECT chunk_id, bm25, lr, sr, coalesce(1.0::DOUBLE / (20 + lr), 0) + coalesce(1.0::DOUBLE / (20 + sr), 0) AS raw FROM k_lex FULL JOIN k_sem USING (chunk_id)),
k_scaled AS (SELECT *, CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 0.5 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END AS r,
  CASE WHEN bm25 IS NULL OR max(bm25) OVER () = min(bm25) OVER () THEN 0.5 ELSE 1 - (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS b FROM k_both),
k_fused AS (SELECT chunk_id, 0.7 * r + 0.3 * b AS score, CASE WHEN sr IS NULL THEN 'lexical' WHEN lr IS NULL THEN 'semantic' ELSE 'hybrid' END AS source_type,
  row_number() OVER (ORDER BY 0.7 * r + 0.3 * b DESC, chunk_id) AS prior FROM k_scaled QUALIFY prior <= 50)"""
)


@query(with_("k_chunks", "k_tokens", more=_FUSED) + "SELECT chunk_id, round(score, 6) AS score, source_type FROM k_fused")
def rrf_fusion(m: Model) -> DataFrame:
    chunks = m.chunks()
    fused = fusion.fuse(lexical.search(chunks, QUERY, 50), vectors.semantic(m.vectors(), chunks, _query_vector(m), 50), top_n=50)
    return fused.select("chunk_id", F.round("score", 6).alias("score"), "source_type")


_BOOSTED = """, k_final AS (SELECT f.chunk_id, f.source_type, original_path, score * CASE WHEN is_deprecated THEN 0.2 ELSE 1 END * CASE WHEN is_official THEN 1.5 ELSE 1 END
    * CASE WHEN updated_at > 1735689600 - 90 * 86400 THEN 1.2 ELSE 1 END * CASE d.source_type WHEN 'src1' THEN 1.3 WHEN 'src2' THEN 0.7 ELSE 1 END AS s, prior
  FROM k_fused f JOIN k_chunks c USING (chunk_id) JOIN k_docs d ON d.id = c.doc_id)"""
_SETTINGS = search.Settings(boosts=fusion.Boosts(authority={"src1": 1.3, "src2": 0.7}))


@query(with_("k_docs", "k_chunks", "k_tokens", more=_FUSED + _BOOSTED) + "SELECT chunk_id, row_number() OVER (ORDER BY s DESC, prior) AS rank, round(s, 6) AS score, source_type, original_path FROM k_final QUALIFY rank <= 10")
def hybrid_search(m: Model) -> DataFrame:
    """The flagship: two legs, fusion, boosts, documents. Chunks are cut once, as a store would hold them."""
    found = search.hybrid(materialize(m.chunks(), "chunks"), m.documents(), m.vectors(), QUERY, lambda _: _query_vector(m), AS_OF, settings=_SETTINGS)
    return found.select("chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"), "source_type", "original_path")


@query(with_("k_docs", "k_chunks", "k_tokens", more=_FUSED + _BOOSTED) + "SELECT chunk_id, row_number() OVER (ORDER BY s DESC, prior) AS rank, round(s, 6) AS score FROM k_final")
def rerank_boosts(m: Model) -> DataFrame:
    chunks = m.chunks()
    fused = fusion.fuse(lexical.search(chunks, QUERY, 50), vectors.semantic(m.vectors(), chunks, _query_vector(m), 50), top_n=50)
    ranked = fused.withColumn("prior", F.row_number().over(fusion.Window.orderBy(F.desc("score"), "chunk_id")))
    again = fusion.rerank(search.enrich(ranked, chunks, m.documents()), AS_OF, _SETTINGS.boosts)
    return again.select("chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(with_("k_chunks", "k_tokens", more=_BM25) + "SELECT chunk_id, round(1 / bm25, 6) AS score, 'lexical' AS source_type, row_number() OVER (ORDER BY bm25, chunk_id) AS prior FROM k_bm QUALIFY prior <= 30")
def standalone_lexical(m: Model) -> DataFrame:
    rows = fusion.standalone(lexical.search(m.chunks(), QUERY, 30), "lexical")
    return rows.select("chunk_id", F.round("score", 6).alias("score"), "source_type", F.col("prior").cast("bigint").alias("prior"))


# ---- catalog -----------------------------------------------------------------------------------------------------


@query(
    with_("k_docs", "k_chunks", "k_entities", "k_facts", "k_links")
    + """SELECT 'documents' AS metric, count(*) AS value FROM k_docs UNION ALL SELECT 'chunks', count(*) FROM k_chunks UNION ALL SELECT 'entities', count(*) FROM k_entities
UNION ALL SELECT 'facts', count(*) FROM k_facts UNION ALL SELECT 'links', count(*) FROM k_links UNION ALL SELECT 'domains', count(DISTINCT lang) FROM k_docs
UNION ALL SELECT 'source_types', count(DISTINCT source_type) FROM k_docs UNION ALL SELECT 'entity_types', count(DISTINCT type) FROM k_entities
UNION ALL SELECT 'entity_domains', count(DISTINCT domain) FROM k_entities UNION ALL SELECT 'predicates', count(DISTINCT predicate) FROM k_facts
UNION ALL SELECT 'graph_nodes', count(*) FROM (SELECT s FROM k_links UNION SELECT o FROM k_links)"""
)
def catalog_overview(m: Model) -> DataFrame:
    return catalog.overview(m.documents(), m.chunks(), m.entities(), m.facts(), m.links())


@query("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY 1")
def docs_by_type(m: Model) -> DataFrame:
    return catalog.counts_by(m.documents(), "source_type")


@query("SELECT DISTINCT lang AS domain FROM documents")
def unique_domains(m: Model) -> DataFrame:
    return catalog.distinct_domains(m.documents())


@query("SELECT doc_id AS id, 'docs/' || source || '/' || doc_id AS original_path FROM documents ORDER BY doc_id LIMIT 40 OFFSET 80")
def docs_paginated(m: Model) -> DataFrame:
    rows, _ = catalog.page(m.documents().select("id", "original_path"), 80, 40)
    return rows


@query(with_("k_entities") + "SELECT id, type, name, domain FROM k_entities WHERE contains(lower(name), 'er#0000') AND type = 'customer'")
def entity_like_filter(m: Model) -> DataFrame:
    return catalog.where(m.entities(), name=("~", "ER#0000"), type=("=", "customer"), domain=("=", ""))


@query(with_("k_entities") + "SELECT type, domain, count(*) AS n FROM k_entities GROUP BY ALL")
def entities_by_type(m: Model) -> DataFrame:
    return catalog.counts_by(m.entities(), "type", "domain")


@query(with_("k_facts", "k_entities") + "SELECT s AS id, predicate, status FROM k_facts WHERE contains(predicate, 'located') AND status = 'approved' AND EXISTS (SELECT 1 FROM k_entities e WHERE e.id IN (s, o) AND contains(lower(e.name), 'er#00000000'))")
def fact_search(m: Model) -> DataFrame:
    return catalog.search_facts(m.facts(), m.entities(), predicate="LOCATED", status="approved", entity="ER#00000000").select("id", "predicate", "status")


@query(with_("k_facts") + "SELECT e AS entity_id, s, o FROM (SELECT DISTINCT s, o, unnest([s, o]) AS e FROM k_facts WHERE status = 'approved') WHERE e BETWEEN 2000000000 AND 2000000004 OR e = 1000000001")
def facts_by_entity(m: Model) -> DataFrame:
    ids = m.spark.createDataFrame([(NATION + k,) for k in range(5)] + [(REGION + 1,)], "id bigint")
    return catalog.facts_of(m.facts(), ids).select("entity_id", F.col("subject_entity_id").alias("s"), F.col("object_entity_id").alias("o"))


@query(with_("k_facts") + "SELECT s AS id, count(o_orderkey) AS weight FROM k_facts LEFT JOIN orders ON s = 4000000000 + o_custkey GROUP BY s")
def fact_weights(m: Model) -> DataFrame:
    return catalog.fact_weights(m.facts(), m.fact_sources())


@query("SELECT content_hash, n FROM (SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def content_hash_dedup(m: Model) -> DataFrame:
    return catalog.counts_by(m.documents(), "content_hash").filter("n > 1")


@query("SELECT DISTINCT doc_id, k, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN v::VARCHAR[] ELSE [v ->> '$'] END) AS value FROM (SELECT event_id AS doc_id, 'k' AS k, json(props) -> '$.k' AS v FROM events) WHERE v IS NOT NULL")
def json_membership(m: Model) -> DataFrame:
    values = F.explode(catalog.json_values(F.col("props"), "$.k"))
    return m.table("events").select(F.col("event_id").alias("doc_id"), F.lit("k").alias("k"), values.alias("value")).distinct()


# ---- graph -------------------------------------------------------------------------------------------------------


def _graph(m: Model) -> tuple[DataFrame, DataFrame]:
    entities = m.entities()
    return graph.nodes(entities), graph.edges(entities, m.facts(), m.links())


@contextmanager
def _stored_graph(m: Model) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The graph in the shared folder while it is walked: each level reads it anew, and no result does."""
    stored = tuple(materialize(df, name) for df, name in zip(_graph(m), ("nodes", "edges"), strict=True))
    yield stored
    for df in stored:
        discard(df)


@query(with_("k_facts", "k_links", "k_edges") + "SELECT s AS from_id, o AS to_id, relation, kind FROM k_edges")
def graph_edges(m: Model) -> DataFrame:
    return _graph(m)[1]


@query(with_("k_entities", "k_facts", "k_links", "k_edges") + "SELECT n AS nodes, e AS edges, round(2.0 * e / n, 6) AS average_degree FROM (SELECT count(*) AS n FROM k_entities), (SELECT count(*) AS e FROM k_edges)")
def graph_stats(m: Model) -> DataFrame:
    return graph.stats(*_graph(m)).withColumn("average_degree", F.round("average_degree", 6))


@query(with_("k_entities") + "SELECT id, name, CASE WHEN lower(name) = 'asia' THEN 0 WHEN starts_with(lower(name), 'asia') THEN 1 ELSE 2 END AS tier FROM k_entities WHERE contains(lower(name), 'a') AND type IN ('region', 'nation')")
def find_partial_tiers(m: Model) -> DataFrame:
    nodes = graph.nodes(m.entities()).filter(F.col("type").isin("region", "nation"))
    tier = F.when(F.col("name_key") == "asia", 0).when(F.startswith("name_key", F.lit("asia")), 1).otherwise(2)
    return graph.find_partial(nodes, "A", 1000).select("id", "name", tier.alias("tier"))


@query(with_("k_facts", "k_links", "k_edges") + "SELECT id, array_to_string(list_sort(list(DISTINCT o)), ',') AS neighbors FROM (SELECT s AS id, o FROM k_edges UNION ALL SELECT o, s FROM k_edges) GROUP BY id")
def neighbors(m: Model) -> DataFrame:
    return graph.neighbors(_graph(m)[1]).select("id", F.array_join("neighbors", ",").alias("neighbors"))


_BFS = """k_walk(id, depth) AS (SELECT 5000000001::BIGINT, 0 UNION SELECT e.o, w.depth + 1 FROM k_walk w JOIN k_links e ON e.s = w.id WHERE w.depth < 4)"""


@query(with_("k_links", more=_BFS, recursive=True) + "SELECT id, min(depth) AS depth FROM k_walk GROUP BY id")
def bfs_reachable_depth(m: Model) -> DataFrame:
    with _stored_graph(m) as stored:
        found, _ = graph.traverse(*stored, PART + 1, graph.Options(max_depth=4, max_nodes=10**6, follow_links=True))
    return found


_PART_TREE = """k_reach(id, depth) AS (SELECT 5000000001::BIGINT, 0 UNION SELECT e.o, w.depth + 1 FROM k_reach w JOIN k_links e ON e.s = w.id WHERE w.depth < 3),
k_depth AS (SELECT id, min(depth) AS depth FROM k_reach GROUP BY id),
k_parent AS (SELECT n.id, n.depth, min(p.id) AS parent FROM k_depth n JOIN k_links e ON e.s = n.id JOIN k_depth p ON p.id = e.o AND p.depth = n.depth - 1 GROUP BY n.id, n.depth)"""


@query(
    with_("k_links", more=_PART_TREE, recursive=True)
    + """SELECT least(id, parent) AS from_id, greatest(id, parent) AS to_id, 'same_as' AS relation, 'link' AS kind, depth FROM k_parent
QUALIFY row_number() OVER (ORDER BY depth, parent, least(id, parent), greatest(id, parent)) <= 49"""
)
def bfs_tree_edges(m: Model) -> DataFrame:
    with _stored_graph(m) as stored:
        _, edges = graph.traverse(*stored, PART + 1, graph.Options(max_depth=3, max_nodes=50, follow_links=True))
    return edges


#: Walks inside the domain of each start; no start is on a link.
_PATHS = """k_tests AS (SELECT * FROM (VALUES (1, 4000000001, 4000000001, 0), (2, 4000000001, 1000000099, 3), (3, 2000000000, 1000000000, 2)) AS t(pair, a, b, steps)),
k_steps AS (SELECT s::BIGINT AS p, o::BIGINT AS n FROM k_facts WHERE status = 'approved' UNION SELECT o::BIGINT, s::BIGINT FROM k_facts WHERE status = 'approved'),
k_walk(pair, home, node, depth, steps) AS (SELECT pair, domain, a, 0, steps FROM k_tests JOIN k_entities ON id = a
  UNION SELECT w.pair, w.home, e.n, w.depth + 1, w.steps FROM k_walk w JOIN k_steps e ON e.p = w.node JOIN k_entities g ON g.id = e.n WHERE w.depth < w.steps AND lower(g.domain) = lower(w.home))"""


@query(with_("k_facts", "k_entities", more=_PATHS, recursive=True) + "SELECT pair, EXISTS (SELECT 1 FROM k_walk w WHERE w.pair = t.pair AND w.node = t.b) AS found FROM k_tests t")
def path_exists(m: Model) -> DataFrame:
    """Domains bound facts, so a nation's fact to its region cannot be walked from a customer of the nation."""
    with _stored_graph(m) as stored:
        tests = [(1, graph.path_exists(*stored, CUSTOMER + 1, CUSTOMER + 1, 0)), (2, graph.path_exists(*stored, CUSTOMER + 1, REGION + 99, 3)), (3, graph.path_exists(*stored, NATION + 0, REGION + 0, 2))]
    return m.spark.createDataFrame(tests, "pair int, found boolean")


# ---- text keys ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_name AS name, regexp_replace(trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')), '^(the|an|a)( +|$)', '') AS match_key FROM part")
def match_keys(m: Model) -> DataFrame:
    return m.table("part").select(F.col("p_name").alias("name"), text.match_key(F.col("p_name")).alias("match_key")).distinct()


@query("SELECT name, array_to_string(list_distinct_ordered, '|') AS bigrams FROM (SELECT name, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_ordered FROM (SELECT name, list_transform(range(1, length(name)), lambda i: substr(lower(name), i, 2)) AS g FROM (SELECT DISTINCT p_name AS name FROM part)))")
def bigrams(m: Model) -> DataFrame:
    return m.table("part").select(F.col("p_name").alias("name")).distinct().select("name", F.array_join(text.bigrams(F.col("name")), "|").alias("bigrams"))


# ---- resolution, links, extraction -------------------------------------------------------------------------------


#: Jaro-Winkler of the distinct names of parts, written out: y's places that x's characters take, one character a step.
#: k_same holds parts under the least part of their name and brand, k_near the pairs of those that share a bigram.
_JARO = """k_names AS (SELECT domain, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key, min(id) AS id FROM k_entities WHERE type = 'part' GROUP BY ALL),
k_same AS (SELECT n.id AS a, e.id AS b FROM k_names n JOIN k_entities e ON e.type = 'part' AND e.domain = n.domain AND trim(regexp_replace(lower(e.name), '\\s+', ' ', 'g')) = n.key AND e.id <> n.id),
k_grams AS (SELECT *, list_transform(range(1, length(key)), lambda i: substr(key, i, 2)) AS g FROM k_names),
k_met AS (SELECT a.id AS a, b.id AS b, a.key AS x, b.key AS y FROM k_grams a JOIN k_grams b ON a.domain = b.domain AND a.id < b.id AND list_has_any(a.g, b.g)),
k_match(x, y, i, places, met) AS (SELECT DISTINCT x, y, 0::BIGINT, []::BIGINT[], '' FROM k_met
  UNION ALL SELECT x, y, i + 1, CASE WHEN j IS NULL THEN places ELSE list_append(places, j) END, CASE WHEN j IS NULL THEN met ELSE met || substr(x, i + 1, 1) END FROM (
    SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(length(y), i + 1 + reach) + 1), lambda k: substr(y, k, 1) = substr(x, i + 1, 1) AND NOT list_contains(places, k))[1] AS j
    FROM (SELECT *, greatest(0, greatest(length(x), length(y)) // 2 - 1) AS reach FROM k_match WHERE i < length(x)))),
k_jaro AS (SELECT x, y, CASE WHEN m = 0 THEN 0 ELSE (m / length(x) + m / length(y) + (m - swapped / 2) / m) / 3 END AS jaro,
  CASE WHEN m = 0 THEN 0 ELSE length(list_filter(range(1, 5), lambda p: p <= least(length(x), length(y)) AND substr(x, 1, p) = substr(y, 1, p))) END AS prefix
  FROM (SELECT x, y, length(places)::DOUBLE AS m, length(list_filter(range(1, length(places) + 1), lambda k: substr(met, k, 1) <> substr(y, list_sort(places)[k], 1)))::DOUBLE AS swapped FROM k_match WHERE i = length(x))),
k_near AS (SELECT a, b, jaro + prefix * 0.1::DOUBLE * (1 - jaro) AS similarity FROM k_met JOIN k_jaro USING (x, y))"""


@query(with_("k_entities", more=_JARO, recursive=True) + "SELECT a, b, round(similarity, 6) AS similarity FROM k_near WHERE similarity >= 0.85 UNION ALL SELECT a, b, 1.0 FROM k_same")
def jaro_winkler_pairs(m: Model) -> DataFrame:
    names = m.entities().filter("type = 'part'").select("id", "domain", "type", "name")
    return resolve.similar_pairs(names, 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


#: No two words of part names have one stem, and none begins with an article: names with one key are equal names.
_CLUSTERS = (
    _JARO
    + """,
k_pairs AS (SELECT a, b FROM k_near WHERE similarity >= 0.95),
k_joined(id, other) AS (SELECT id, id FROM k_names UNION SELECT j.id, CASE WHEN p.a = j.other THEN p.b ELSE p.a END FROM k_joined j JOIN k_pairs p ON j.other IN (p.a, p.b)),
k_heads AS (SELECT id, min(other) AS cluster FROM k_joined GROUP BY id),
k_all AS (SELECT a, b FROM k_same UNION ALL SELECT id, id FROM k_names),
k_placed AS (SELECT b AS id, cluster FROM k_all JOIN k_heads ON k_heads.id = a)"""
)


@query(
    with_("k_entities", more=_CLUSTERS, recursive=True)
    + "SELECT p.id, cluster, canonical FROM k_placed p JOIN (SELECT cluster, first(name ORDER BY length(name) DESC, e.id) AS canonical FROM k_placed q JOIN k_entities e ON e.id = q.id GROUP BY cluster) USING (cluster)"
)
def cluster_components(m: Model) -> DataFrame:
    return resolve.clusters(m.entities().filter("type = 'part'").select("id", "domain", "type", "name"), 0.95)


@query()
def stem_keys(m: Model) -> DataFrame:
    return m.table("part").select(F.col("p_name").alias("name"), text.stem_key("p_name").alias("stem_key")).distinct()


@query(with_("k_entities") + "SELECT m.id AS mention_id, min(e.id) AS entity_id, 1 AS tier FROM k_entities m JOIN k_entities e ON m.type = 'part' AND e.type = 'part' AND m.domain = e.domain AND lower(m.name) = lower(e.name) GROUP BY m.id")
def resolve_exact_tiers(m: Model) -> DataFrame:
    """Every part finds the least part of its name and brand at the first tier."""
    parts = m.entities().filter("type = 'part'")
    mentions = parts.select(F.col("id").alias("mention_id"), "domain", "type", "name")
    none = m.spark.createDataFrame([], "entity_id bigint, alias string")
    return resolve.candidate_tiers(mentions, parts, none, threshold=0.99)


@query()
def resolver_replay(m: Model) -> DataFrame:
    return resolve.replay(m.entities().filter("type = 'part'").select(F.col("id").alias("mention_id"), "domain", "type", "name"), 0.9)


@query(with_("k_entities") + "SELECT a.id AS s, b.id AS t FROM k_entities a JOIN k_entities b ON a.type = b.type AND lower(a.name) = lower(b.name) AND lower(a.domain) <> lower(b.domain) WHERE a.type = 'part' AND array_length(string_split(a.name, ' ')) >= 2")
def link_equals(m: Model) -> DataFrame:
    parts = m.entities().filter("type = 'part'")
    return linking.equals_linker(parts).select(F.col("subject_entity_id").alias("s"), F.col("target_entity_id").alias("t"))


@query(with_("k_entities") + "SELECT a.id AS s, b.id AS t, CASE WHEN a.domain < 'Brand#2' THEN 'r1' ELSE 'r2' END AS evidence FROM k_entities a JOIN k_entities b ON a.type = b.type AND lower(a.name) = lower(b.name) AND lower(a.domain) < lower(b.domain) WHERE a.type = 'part' AND (a.domain < 'Brand#2' OR contains(b.name, 'a'))")
def rule_linker(m: Model) -> DataFrame:
    parts = m.entities().filter("type = 'part'")
    rules = [linking.Rule("r2", "b.name.contains('a')", "alike", 1), linking.Rule("r1", "a.domain < 'Brand#2' && !(size(facts(a)) > 0)", "alike", 5)]
    found = linking.rule_linker(linking.cross_domain_pairs(parts), linking.prepare(parts), rules)
    return found.select(F.col("subject_entity_id").alias("s"), F.col("target_entity_id").alias("t"), "evidence")


@query(r"""WITH RECURSIVE """ + with_("k_chunks")[5:] + r"SELECT DISTINCT chunk_id AS id, unnest(regexp_extract_all(search_text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z.]+')) AS name FROM k_chunks")
def ner_regex_email(m: Model) -> DataFrame:
    return extract.by_patterns(m.chunks(), [extract.Pattern("Email", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z.]+")]).select("id", "name")


_QUOTE = r"""q AS (SELECT chunk_id, search_text AS t, nullif(strpos(lower(search_text), 'the'), 0) AS s, nullif(strpos(lower(search_text), 'and'), 0) AS o FROM k_chunks),
w AS (SELECT *, least(s, o) AS f FROM q),
v AS (SELECT chunk_id, CASE WHEN f IS NULL THEN substr(t, 1, 120) ELSE substr(t, greatest(f - 60, 1), least(f + 63, length(t) + 1) - greatest(f - 60, 1)) END AS body,
  CASE WHEN f IS NULL THEN length(t) > 120 ELSE f - 60 > 1 OR f + 63 <= length(t) END AS cut FROM w),
l AS (SELECT chunk_id, cut, body, CASE WHEN regexp_matches(body, '[\n\r]') THEN trim(regexp_replace(body, '[\n\r][^\n\r]*$', '')) ELSE body END AS line FROM v)"""


@query(with_("k_chunks", more=_QUOTE) + "SELECT chunk_id, CASE WHEN cut THEN CASE WHEN ends_with(line, '...') THEN line ELSE line || '...' END ELSE body END AS quote FROM l")
def quote_extract(m: Model) -> DataFrame:
    return m.chunks().select("chunk_id", extract.quote(F.col("search_text"), F.lit("the"), F.lit("and")).alias("quote"))


# ---- queue, reconciliation, garbage ------------------------------------------------------------------------------


@query(with_("k_events") + "SELECT type, identity, arg_max(event, row(due, event_id)) AS event, max(due) AS next_attempt_at, 'pending' AS status FROM k_events GROUP BY type, identity")
def queue_upsert(m: Model) -> DataFrame:
    return maintenance.enqueue(m.events().withColumnRenamed("event_id", "order")).select("type", "identity", "event", "next_attempt_at", "status")


def _tasks(m: Model) -> DataFrame:
    return m.events().select(F.col("event_id").alias("id"), "type", "identity", F.when(F.col("event_id") % 5 == 0, "error").when(F.col("event_id") % 5 == 1, "processing").otherwise("pending").alias("status"), F.pmod("event_id", F.lit(3)).cast("int").alias("attempts"), F.col("at").alias("next_attempt_at"))


_TASKS = "k_tasks AS (SELECT event_id AS id, type, identity, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 = 1 THEN 'processing' ELSE 'pending' END AS status, (event_id % 3)::INT AS attempts, due AS next_attempt_at FROM k_events)"
_NOW = 1705000000


@query(with_("k_events", more=_TASKS) + f"SELECT id, 'processing' AS status FROM k_tasks WHERE status = 'pending' AND next_attempt_at <= {_NOW} ORDER BY next_attempt_at, id LIMIT 100")
def queue_claim(m: Model) -> DataFrame:
    return maintenance.claim(_tasks(m), _NOW).select("id", "status")


@query(with_("k_events", more=_TASKS) + f"SELECT id, CASE WHEN attempts = 2 THEN 'error' ELSE 'pending' END AS status, attempts + 1 AS attempts, CASE WHEN attempts = 2 THEN next_attempt_at ELSE {_NOW} + (30 << attempts) END AS next_attempt_at FROM k_tasks")
def queue_backoff(m: Model) -> DataFrame:
    return maintenance.failed(_tasks(m), _NOW).select("id", "status", "attempts", "next_attempt_at")


@query(with_("k_events", more=_TASKS) + "SELECT id, CASE WHEN status = 'processing' THEN 'pending' WHEN status = 'error' AND starts_with(identity, '1') THEN 'pending' ELSE status END AS status FROM k_tasks")
def queue_recover(m: Model) -> DataFrame:
    return maintenance.reset_errors(maintenance.recovered(_tasks(m)), "1").select("id", "status")


@query(
    """WITH disk AS (SELECT 'docs/' || source || '/' || doc_id AS path, sha256(text) AS now FROM documents WHERE source <> 'src7'),
known AS (SELECT 'docs/' || source || '/' || doc_id AS path, sha256(CASE WHEN source = 'src5' THEN text || 'x' ELSE text END) AS known FROM documents WHERE lang <> 'es'),
doom AS (SELECT 'docs/' || source || '/' || doc_id AS path FROM documents WHERE source = 'src3')
SELECT path, CASE WHEN now IS NULL THEN 'delete' WHEN now = known THEN CASE WHEN doom.path IS NOT NULL THEN 'cancel_delete' ELSE 'unchanged' END ELSE 'index' END AS action
FROM disk FULL JOIN known USING (path) LEFT JOIN doom USING (path)"""
)
def reconcile_diff(m: Model) -> DataFrame:
    docs = m.documents().select("source_type", F.col("domains")[0].alias("lang"), F.col("original_path").alias("path"), "content_hash", "content")
    disk = docs.filter("source_type <> 'src7'").select("path", F.col("content_hash").alias("hash"))
    known = docs.filter("lang <> 'es'").select("path", F.when(F.col("source_type") == "src5", F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("hash"))
    tasks = docs.filter("source_type = 'src3'").select(F.lit("doc:delete").alias("type"), F.col("path").alias("identity"), F.lit("pending").alias("status"))
    return maintenance.reconcile(disk, known, tasks)


@query(with_("k_entities", "k_facts") + "SELECT id FROM k_entities WHERE id NOT IN (SELECT 5000000000 + l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) AND id NOT IN (SELECT s FROM k_facts UNION SELECT o FROM k_facts)")
def gc_orphans(m: Model) -> DataFrame:
    """Parts never returned in a large amount have no source here, and no fact."""
    sources = m.table("lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select((F.lit(PART) + F.col("l_partkey")).alias("entity_id"))
    return maintenance.orphan_entities(m.entities(), sources, m.facts()).select("id")


@query(with_("k_facts") + "SELECT CASE WHEN s = 2000000003 THEN 2000000002 ELSE s END AS s, predicate, CASE WHEN o = 2000000003 THEN 2000000002 ELSE o END AS o FROM k_facts WHERE NOT (s = 2000000003 AND o = (SELECT o FROM k_facts WHERE s = 2000000002))")
def merge_entities(m: Model) -> DataFrame:
    """Two nations made one of a kind and merged: facts follow, a repeated one goes."""
    entities = m.entities().withColumn("domain", F.when(F.col("type") == "nation", "one").otherwise(F.col("domain")))
    pair = lambda a, b: m.spark.createDataFrame([], f"{a} bigint, {b} bigint")
    tables = {"entities": entities, "facts": m.facts(), "chunk_entities": pair("chunk_id", "entity_id"), "entity_sources": pair("entity_id", "document_id"), "entity_links": m.links().limit(0), "entity_aliases": m.spark.createDataFrame([], "entity_id bigint, alias string")}
    out, _ = resolve.merge(tables, NATION + 2, NATION + 3)
    return out["facts"].select(F.col("subject_entity_id").alias("s"), "predicate", F.col("object_entity_id").alias("o"))


@query("WITH g AS (SELECT ts, event_type, sum(CASE WHEN gap > 30 OR gap IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS k FROM (SELECT *, epoch(ts - lag(ts) OVER (ORDER BY ts, event_id)) AS gap FROM events)) SELECT floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY k")
def session_debounce(m: Model) -> DataFrame:
    events = m.table("events").select("ts", F.col("event_type").alias("path"))
    return maintenance.debounced(events, 30).select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "n")


@query("WITH log AS (SELECT event_id % 400 AS chunk_id, event_id AS version, event_id % 9 = 0 AS deleted FROM events) SELECT chunk_id, max(version) AS version FROM log GROUP BY 1 HAVING NOT arg_max(deleted, version)")
def vector_supersession(m: Model) -> DataFrame:
    log = m.table("events").select(F.pmod("event_id", F.lit(400)).alias("chunk_id"), F.col("event_id").alias("version"), (F.col("event_id") % 9 == 0).alias("deleted"), F.array(F.col("value").cast("float")).alias("embedding"))
    return vectors.latest(log).select("chunk_id", "version")


@query(with_("k_chunks") + "SELECT 'missing' AS what, chunk_id FROM k_chunks WHERE chunk_id NOT IN (SELECT vec_id * 1000 FROM embeddings) UNION ALL SELECT 'orphan', vec_id * 1000 FROM embeddings WHERE vec_id * 1000 NOT IN (SELECT chunk_id FROM k_chunks)")
def vector_heal(m: Model) -> DataFrame:
    v, c = m.vectors(), m.chunks()
    return vectors.missing(v, c).select(F.lit("missing").alias("what"), "chunk_id").unionByName(vectors.orphans(v, c).select(F.lit("orphan").alias("what"), "chunk_id"))


# ---- sources -----------------------------------------------------------------------------------------------------


@query()
def html_to_markdown(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


@query()
def markdown_chunks(m: Model) -> DataFrame:
    pages = m.table("pages").select("page_id", html.html_to_markdown("html").alias("markdown"))
    return chunking.structured_chunks(pages, chunking.Chunker("markdown"), "page_id", "markdown")
