"""More registered queries of the core engine: listings, tools, ingestion parts, linking, the queue and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import catalog, extract, graph, linking, maintenance, search, vectors
from millrace.operators.tools import Tools
from millrace.plans.model import CUSTOMER, NATION, REGION, Model, with_
from millrace.plans.queries import _TASKS, AS_OF, ORACLE_SQL, QUERIES, _graph, _query_vector, _stored_graph, _tasks, query

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- the knowledge base that tools read --------------------------------------------------------------------------

#: Chunk and entity, document and entity, by the numbers of documents and nations.
_ABOUT = "k_about AS (SELECT chunk_id, doc_id, 2000000000 + doc_id % 25 AS entity_id FROM k_chunks)"


def _about(m: Model) -> DataFrame:
    return m.chunks().select("chunk_id", "doc_id", (F.lit(NATION) + F.pmod("doc_id", F.lit(25))).cast("bigint").alias("entity_id"))


def _tables(m: Model) -> dict[str, DataFrame]:
    about = _about(m)
    return {
        "documents": m.documents(),
        "chunks": m.chunks(),
        "entities": m.entities(),
        "facts": m.facts(),
        "fact_sources": m.fact_sources(),
        "entity_sources": about.select("entity_id", F.col("doc_id").alias("document_id")).distinct(),
        "entity_links": m.links(),
        "entity_aliases": m.table("nation").select((F.lit(NATION) + F.col("n_nationkey")).cast("bigint").alias("entity_id"), F.lower("n_name").alias("alias")),
        "chunk_entities": about.select("chunk_id", "entity_id"),
        "vectors": m.vectors(),
    }


def _tools(m: Model) -> Tools:
    return Tools(_tables(m), lambda _: _query_vector(m), AS_OF)


@query("SELECT doc_id AS id, source AS source_type FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 30")
def tool_catalog_documents(m: Model) -> DataFrame:
    rows, _, _ = _tools(m).catalog_documents(source_type="src1", limit=30)
    return rows.select("id", "source_type")


@query(with_("k_entities") + "SELECT id, name FROM k_entities WHERE type = 'part' AND contains(lower(name), 'a') ORDER BY id LIMIT 50 OFFSET 50")
def tool_catalog_entities(m: Model) -> DataFrame:
    """The second page, by the cursor of the first."""
    tools = _tools(m)
    _, _, cursor = tools.catalog_entities(type="part", name="A", limit=50)
    rows, _, _ = tools.catalog_entities(type="part", name="A", cursor=cursor)
    return rows.select("id", "name")


@query(with_("k_entities") + "SELECT id, name, domain FROM k_entities WHERE type = 'supplier' ORDER BY id LIMIT 200")
def tool_search_entities_by_type(m: Model) -> DataFrame:
    return _tools(m).search_entities_by_type("supplier", limit=200)[0].select("id", "name", "domain")


@query(with_("k_facts", "k_entities") + "SELECT s AS id, predicate FROM k_facts WHERE status = 'draft' AND EXISTS (SELECT 1 FROM k_entities e WHERE e.id IN (s, o) AND contains(lower(e.name), 'nation_4')) ORDER BY s LIMIT 100")
def tool_search_facts(m: Model) -> DataFrame:
    return _tools(m).search_facts(entity="Nation_4", status="draft", limit=100)[0].select("id", "predicate")


@query(
    with_("k_facts")
    + "SELECT s AS id, predicate, status, (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT o_orderkey::VARCHAR AS d FROM orders WHERE o_custkey = 1)) AS documents FROM k_facts WHERE s = 4000000001"
)
def tool_get_fact_by_id(m: Model) -> DataFrame:
    found = _tools(m).get_fact_by_id(CUSTOMER + 1)
    return found.select("id", "predicate", "status", F.array_join(F.array_sort(F.transform("documents", lambda x: x.cast("string"))), ",").alias("documents"))


@query(with_("k_chunks") + "SELECT chunk_id, seq, start_offset, end_offset, sha256(search_text) AS text_hash FROM k_chunks WHERE chunk_id = 7000")
def tool_get_chunk_by_id(m: Model) -> DataFrame:
    return _tools(m).get_chunk_by_id(7000).select("chunk_id", "seq", "start_offset", "end_offset", F.sha2("search_text", 256).alias("text_hash"))


@query(
    with_("k_docs", "k_chunks", "k_entities", more=_ABOUT)
    + """SELECT 'document' AS part, id FROM k_docs WHERE id = 7 UNION ALL SELECT 'chunk', chunk_id FROM k_chunks WHERE doc_id = 7
UNION ALL SELECT DISTINCT 'entity', entity_id FROM k_about WHERE doc_id = 7 UNION ALL SELECT 'fact', 4000000000 + o_custkey FROM orders WHERE o_orderkey = 7"""
)
def tool_get_document_context(m: Model) -> DataFrame:
    parts = _tools(m).get_document_context(7, facts=True)
    row = lambda name, df, c="id": df.select(F.lit(name).alias("part"), F.col(c).alias("id"))
    return row("document", parts["document"]).unionByName(row("chunk", parts["chunks"], "chunk_id")).unionByName(row("entity", parts["entities"])).unionByName(row("fact", parts["facts"]))


_HOOD = """k_inside AS (SELECT e.s, e.o, a.domain AS home, b.domain AS far FROM k_facts e JOIN k_entities a ON a.id = e.s JOIN k_entities b ON b.id = e.o WHERE e.status = 'approved'),
k_walk(node, depth) AS (SELECT 1000000002::BIGINT, 0 UNION SELECT CASE WHEN e.s = w.node THEN e.o ELSE e.s END, w.depth + 1 FROM k_walk w JOIN k_inside e ON w.node IN (e.s, e.o)
  WHERE w.depth < 2 AND CASE WHEN e.s = w.node THEN e.far ELSE e.home END = 'ASIA')"""


@query(with_("k_facts", "k_entities", more=_HOOD, recursive=True) + "SELECT node AS id, min(depth) AS depth FROM k_walk GROUP BY node")
def tool_get_entity_relations(m: Model) -> DataFrame:
    """ASIA and, inside its domain, its nations; their customers lie in domains of their own."""
    return _tools(m).get_entity_relations(REGION + 2, depth=2)[0]


_LINKED = "k_most AS (SELECT s AS start FROM k_links GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"


def _most_linked(m: Model) -> int:
    """The entity of most links, the least id among equals."""
    return m.links().groupBy("subject_entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_entity_id").first()[0]


@query(with_("k_links", more=_LINKED) + "SELECT DISTINCT o AS target, 'same_as' AS relation_type, 'equals' AS method, 0.9 AS confidence FROM k_links, k_most WHERE s = start")
def tool_get_entity_links(m: Model) -> DataFrame:
    found = _tools(m).get_entity_links(_most_linked(m))
    return found.select("target", "relation_type", "method", F.col("confidence").cast("decimal(2,1)").alias("confidence"))


@query(
    with_("k_docs", "k_chunks", "k_facts", more=_ABOUT)
    + """SELECT 'alias' AS part, lower(n_name) AS value FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'document', doc_id::VARCHAR FROM (SELECT DISTINCT doc_id FROM k_about WHERE entity_id = 2000000004)
UNION ALL SELECT 'fact', s::VARCHAR FROM (SELECT s FROM k_facts WHERE status = 'approved' AND 2000000004 IN (s, o) ORDER BY s DESC LIMIT 100)"""
)
def tool_get_entity_dossier(m: Model) -> DataFrame:
    parts = _tools(m).get_entity_dossier(NATION + 4, depth=1)
    row = lambda name, df, c: df.select(F.lit(name).alias("part"), F.col(c).cast("string").alias("value"))
    return row("alias", parts["aliases"], "alias").unionByName(row("document", parts["documents"], "id")).unionByName(row("fact", parts["facts"], "id"))


# ---- listings and lookups ----------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id % 365 DESC, doc_id) AS place FROM documents QUALIFY place <= 60")
def ordered_listing(m: Model) -> DataFrame:
    """The 60 documents changed last."""
    rows = catalog.ordered(m.documents().select("id", "updated_at"), "updated_at", descending=True).limit(60)
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("bigint").alias("place"))


@query(with_("k_docs") + "SELECT id FROM k_docs WHERE updated_at > 1704067200 + 300 * 86400")
def created_since(m: Model) -> DataFrame:
    return catalog.created_since(m.documents(), 1704067200 + 300 * 86400, "updated_at").select("id")


@query(with_("k_docs", "k_chunks", "k_entities", "k_facts") + "SELECT 'documents' AS metric, count(*) AS value FROM k_docs UNION ALL SELECT 'chunks', count(*) FROM k_chunks UNION ALL SELECT 'entities', count(*) FROM k_entities UNION ALL SELECT 'facts', count(*) FROM k_facts")
def health(m: Model) -> DataFrame:
    return catalog.health(m.documents(), m.chunks(), m.entities(), m.facts())


@query(with_("k_entities") + "SELECT id, type FROM k_entities WHERE lower(trim(name)) = 'nation_7'")
def folded_name_lookup(m: Model) -> DataFrame:
    return catalog.folded_name(m.entities(), "  NATION_7 ").select("id", "type")


@query("SELECT offset_, replace(replace(base64(encode('{\"offset\":' || offset_ || ',\"limit\":' || limit_ || '}')), chr(10), ''), ' ', '') AS cursor FROM (SELECT DISTINCT doc_id * 20 AS offset_, 20 + doc_id % 7 AS limit_ FROM documents WHERE doc_id < 100)")
def cursor_codec(m: Model) -> DataFrame:
    """Each cursor is decoded and encoded again."""
    pages = m.table("documents").filter("doc_id < 100").select((F.col("doc_id") * 20).alias("o"), (20 + F.pmod("doc_id", F.lit(7))).alias("l")).distinct().collect()
    return m.spark.createDataFrame([(r["o"], catalog.encode_cursor(*catalog.decode_cursor(catalog.encode_cursor(r["o"], r["l"])))) for r in pages], "offset_ bigint, cursor string")


@query(with_("k_chunks", more=_ABOUT) + "SELECT entity_id, chunk_id FROM k_about JOIN k_chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq, chunk_id) <= 3")
def first_texts(m: Model) -> DataFrame:
    return catalog.first_texts(m.chunks().select("chunk_id", "seq", "search_text"), _about(m).select("chunk_id", "entity_id"), 3).select("entity_id", "chunk_id")


@query(with_("k_facts") + "SELECT o AS key, string_agg(s::VARCHAR, ',' ORDER BY s) AS sources FROM (SELECT DISTINCT s, o FROM k_facts) GROUP BY o")
def provenance(m: Model) -> DataFrame:
    rows = catalog.provenance(m.facts(), "object_entity_id", "subject_entity_id")
    return rows.select(F.col("object_entity_id").alias("key"), F.array_join("values", ",").alias("sources"))


@query(with_("k_entities") + "SELECT id, name FROM k_entities WHERE type <> 'part' UNION ALL SELECT min(id), name FROM k_entities WHERE type = 'part' GROUP BY name")
def get_or_create(m: Model) -> DataFrame:
    """Parts are created once a name, what is known stays."""
    have = m.entities().filter("type <> 'part'").select("id", "name")
    return catalog.upsert(have, m.entities().filter("type = 'part'").select("id", "name"), ["name"], ["id"])


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'changed' ELSE n_name END AS name FROM nation WHERE n_nationkey % 5 <> 1")
def update_and_delete(m: Model) -> DataFrame:
    rows = m.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    changed = catalog.upsert(rows, rows.filter("id % 3 = 0").withColumn("name", F.lit("changed")), ["id"], ["name"], first_wins=False)
    return catalog.delete(changed, rows.filter("id % 5 = 1").select("id"), "id")


@query(with_("k_docs", "k_chunks") + "SELECT total, count(*) AS n FROM (SELECT count(*) OVER () AS total, id FROM k_docs ORDER BY id LIMIT 40 OFFSET 80) GROUP BY total")
def page_total(m: Model) -> DataFrame:
    rows, total = catalog.page(m.documents().select("id"), 80, 40)
    return rows.agg(F.count("*").alias("n")).select(F.lit(total).cast("bigint").alias("total"), "n")


# ---- graph -------------------------------------------------------------------------------------------------------


@query(with_("k_entities") + "SELECT min(id) AS id FROM k_entities WHERE lower(name) = 'nation_8' AND lower(domain) = 'europe'")
def find_exact(m: Model) -> DataFrame:
    return graph.find_exact(_graph(m)[0], "  nation_8", "Europe ").select("id")


@query(with_("k_entities") + "SELECT id FROM k_entities WHERE type = 'supplier'")
def nodes_by_type(m: Model) -> DataFrame:
    return graph.nodes_by_type(_graph(m)[0], "supplier").select("id")


@query(
    with_("k_entities")
    + """SELECT id, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'a' THEN 0 WHEN starts_with(lower(name), 'a') THEN 1 ELSE 2 END, name, id) AS place
FROM k_entities WHERE contains(lower(name), 'a') AND contains(name, '#') = false"""
)
def find_partial_order(m: Model) -> DataFrame:
    """The operator's own order, over all entities whose name has no number."""
    found = graph.find_partial(_graph(m)[0].filter("not contains(name, '#')"), "A", 10**7)
    return found.select("id", F.row_number().over(Window.orderBy("tier", "name", "id")).cast("bigint").alias("place"))


_TREE = (
    _LINKED
    + """, k_reach(id, depth) AS (SELECT start, 0 FROM k_most UNION SELECT e.o, w.depth + 1 FROM k_reach w JOIN k_links e ON e.s = w.id WHERE w.depth < 3),
k_depth AS (SELECT id, min(depth) AS depth FROM k_reach GROUP BY id),
k_parent AS (SELECT n.id, n.depth, min(p.id) AS parent FROM k_depth n JOIN k_links e ON e.s = n.id JOIN k_depth p ON p.id = e.o AND p.depth = n.depth - 1 GROUP BY n.id, n.depth)"""
)


@query(with_("k_links", more=_TREE, recursive=True) + "SELECT least(id, parent) AS from_id, greatest(id, parent) AS to_id, 'link' AS kind, depth FROM k_parent")
def bfs_tree(m: Model) -> DataFrame:
    """The discovery edges from the entity of most links."""
    with _stored_graph(m) as stored:
        _, edges = graph.traverse(*stored, _most_linked(m), graph.Options(max_depth=3, max_nodes=10**6, follow_links=True))
    return edges.select("from_id", "to_id", "kind", "depth")


@query(
    with_("k_facts", "k_entities")
    + """SELECT r.id AS origin, n.id AS from_id, r.id AS to_id, 1 AS depth FROM k_entities n JOIN k_facts f ON f.s = n.id JOIN k_entities r ON r.id = f.o WHERE r.type = 'region'
UNION ALL SELECT n.id, n.id, f.o, 1 FROM k_entities n JOIN k_facts f ON f.s = n.id WHERE n.type = 'nation'
UNION ALL SELECT n.id, x.s, f.o, 2 FROM k_entities n JOIN k_facts f ON f.s = n.id JOIN k_facts x ON x.o = f.o AND x.s <> n.id WHERE n.type = 'nation'"""
)
def graph_walks(m: Model) -> DataFrame:
    """Neighbourhoods of all regions and nations, each inside its domain."""
    starts = m.entities().filter("type in ('region', 'nation')").select("id")
    return graph.traverse_many(*_graph(m), starts, graph.Options(max_depth=2)).select("origin", "from_id", "to_id", "depth")


@query(
    with_("k_facts", "k_entities")
    + """SELECT n.id AS entity_id, (SELECT count(*) FROM k_facts f JOIN k_facts g ON g.o = f.o AND f.s = n.id) AS n_edges,
(SELECT count(*) FROM k_facts x WHERE x.status = 'approved' AND n.id IN (x.s, x.o)) AS n_facts FROM k_entities n WHERE n.type = 'nation'"""
)
def graph_expand(m: Model) -> DataFrame:
    """Expansion of a result that names all nations: edges of each one's neighbourhood and its approved facts."""
    named = m.entities().filter("type = 'nation'").agg(F.collect_list(F.struct("name", "id", "type")).alias("entities")).select(F.lit(1).alias("chunk_id"), "entities")
    found = search.expand(named, *_graph(m), m.facts())
    each = found.select(F.explode("related_entities").alias("r"))
    return each.select(F.col("r.entity_id").alias("entity_id"), F.size("r.edges").cast("bigint").alias("n_edges"), F.size("r.facts").cast("bigint").alias("n_facts"))


@query(
    with_("k_facts", "k_entities")
    + """SELECT c_custkey AS pair, c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND EXISTS (SELECT 1 FROM k_facts f WHERE f.s = 2000000000 + c_nationkey AND f.o = 1000000000 + c_custkey % 5)) AS found
FROM customer WHERE c_custkey BETWEEN 1 AND 12"""
)
def paths_between(m: Model) -> DataFrame:
    """From itself; from a customer's nation to a customer, whose domain may not be entered; and from the nation to a region."""
    tests = []
    with _stored_graph(m) as stored:
        for r in m.table("customer").filter("c_custkey between 1 and 12").select("c_custkey", "c_nationkey").collect():
            k, nation = r["c_custkey"], NATION + r["c_nationkey"]
            ends = {0: (CUSTOMER + k, CUSTOMER + k), 1: (nation, CUSTOMER + k), 2: (nation, REGION + k % 5)}[k % 3]
            tests.append((k, graph.path_exists(*stored, *ends, 1)))
    return m.spark.createDataFrame(tests, "pair bigint, found boolean")


@query(
    with_("k_entities", "k_facts")
    + """SELECT 'digraph knowledge {' AS line UNION ALL SELECT '}' UNION ALL SELECT '  ' || id || ' [label="' || name || '"];' FROM k_entities WHERE type IN ('region', 'nation')
UNION ALL SELECT '  ' || s || ' -> ' || o || ' [label="' || predicate || '"];' FROM k_facts WHERE predicate = 'part_of'"""
)
def dot_text(m: Model) -> DataFrame:
    entities = m.entities().filter("type in ('region', 'nation')")
    return graph.to_dot(graph.nodes(entities), graph.edges(entities, m.facts(), m.links()))


# ---- linking, resolution, extraction -----------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation UNION ALL SELECT 100 + n_nationkey, translate(lower(n_name), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувшхыз') FROM nation)
SELECT a.id::BIGINT AS a, b.id::BIGINT AS b FROM e a JOIN e b ON a.id < 100 AND b.id >= 100"""
)
def cross_script(m: Model) -> DataFrame:
    """Nations beside their names in Cyrillic letters, all in one domain: every pair of two scripts."""
    names = m.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("name"))
    other = names.select((F.col("id") + 100).alias("id"), F.translate("name", "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз").alias("name"))
    return linking.cross_script_pairs(names.unionByName(other).withColumn("type", F.lit("nation")).withColumn("domain", F.lit("all")))


@query(r"SELECT DISTINCT name, CASE WHEN regexp_matches(name, '^[^\pL]*\p{Latin}') THEN 'latin' WHEN regexp_matches(name, '^[^\pL]*\p{Cyrillic}') THEN 'cyrillic' ELSE 'other' END AS script FROM (SELECT p_name AS name FROM part UNION ALL SELECT translate(p_name, 'abcdef', 'абцдеф') FROM part UNION ALL SELECT translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01234567890123456789012345') FROM nation)")
def detect_script(m: Model) -> DataFrame:
    part = m.table("part").select("p_name")
    digits = m.table("nation").select(F.translate("n_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789012345"))
    names = part.union(part.select(F.translate("p_name", "abcdef", "абцдеф"))).union(digits).toDF("name").distinct()
    return names.select("name", text.script(F.col("name")).alias("script"))


@query(
    with_("k_facts", "k_entities")
    + """SELECT f.s AS s, f.o AS t, CASE WHEN f.status = 'approved' AND f.s < 4000000000 THEN 'known' WHEN (f.s + f.o) % 2 = 0 THEN 'read' ELSE 'near' END AS evidence FROM k_facts f
WHERE f.predicate = 'located_in'"""
)
def rule_functions(m: Model) -> DataFrame:
    """Pairs of a customer or supplier and its nation, by rules over facts, chunk texts and neighbours."""
    pairs = m.facts().filter("predicate = 'located_in'").select(F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"))
    facts = m.facts().filter(F.col("subject_entity_id") < CUSTOMER).select(F.col("subject_entity_id").alias("id"), "predicate", F.col("object_entity_id").alias("other"))
    chunks = pairs.filter((F.col("a") + F.col("b")) % 2 == 0).select(F.col("a").alias("id"), F.lit("even numbers").alias("text"))
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"))
    rules = [
        linking.Rule("known", "has_fact(a, 'located_in') && size(facts(a)) >= 1 && a.type == 'supplier'", "at", 9),
        linking.Rule("read", "chunk_contains(a, 'even') && size(chunks(a)) == 1", "at", 5),
        linking.Rule("near", "size(neighbors(a)) > 0 && path_exists(a, b) && lower(b.type).startsWith('nat')", "at", 1),
    ]
    found = linking.rule_linker(pairs, linking.prepare(m.entities(), facts, chunks, near, near), rules)
    return found.select(F.col("subject_entity_id").alias("s"), F.col("target_entity_id").alias("t"), "evidence")


@query(
    with_("k_entities")
    + """SELECT a.id AS s, b.id AS t, CASE WHEN lower(a.domain) IN ('brand#11', 'brand#22') AND lower(b.domain) IN ('brand#11', 'brand#22') THEN 'known' ELSE 'equals' END AS method
FROM k_entities a JOIN k_entities b ON a.type = b.type AND lower(a.name) = lower(b.name) AND lower(a.domain) <> lower(b.domain) AND a.type = 'part'
WHERE (lower(a.domain) IN ('brand#11', 'brand#22') AND lower(b.domain) IN ('brand#11', 'brand#22')) OR a.id % 10 = 0 OR b.id % 10 = 0"""
)
def link_driver(m: Model) -> DataFrame:
    """Links of pairs that touch every tenth part, beside those known before, which keep their method."""
    entities = m.entities()
    known = linking.equals_linker(entities.filter("domain in ('Brand#11', 'Brand#22')")).withColumn("method", F.lit("known"))
    some = entities.filter("type = 'part' and id % 10 = 0").select("id")
    links, _ = linking.build_links(entities, known, _about(m).select("entity_id"), linking.Linkers(("equals", "llm")), some)
    return links.select(F.col("subject_entity_id").alias("s"), F.col("target_entity_id").alias("t"), "method")


@query(
    """WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_nationkey + b.n_nationkey) % 2 = 0 AS same, (90 + (a.n_nationkey * b.n_nationkey) % 10) / 100.0 AS confidence FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
n AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT n_nationkey AS id, coalesce(n, 0) AS n, length(n_name) AS l FROM nation LEFT JOIN n ON id = n_nationkey)
SELECT p.a::BIGINT AS a, p.b::BIGINT AS b, (CASE WHEN (x.n, x.l, -x.id) > (y.n, y.l, -y.id) THEN p.a ELSE p.b END)::BIGINT AS into_id FROM p JOIN r x ON x.id = p.a JOIN r y ON y.id = p.b WHERE same AND confidence >= 0.95"""
)
def merge_decisions(m: Model) -> DataFrame:
    """What a model's answers about pairs of nations across scripts merge: sources decide, then length, then the id."""
    names = m.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    pairs = names.select(F.col("id").alias("a")).join(names.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    answers = pairs.withColumn("same_entity", (F.col("a") + F.col("b")) % 2 == 0).withColumn("confidence", (90 + (F.col("a") * F.col("b")) % 10) / 100.0)
    sources = m.table("customer").select(F.col("c_nationkey").cast("bigint").alias("entity_id"))
    return linking.model_decisions(pairs, answers, names, sources, cross_script=True).select("a", "b", F.col("into").alias("into_id"))


@query(
    """WITH f AS (SELECT l_orderkey AS doc_id, l_suppkey % 7 AS s, l_partkey % 11 AS o, l_linenumber % 3 = 0 AS other FROM lineitem)
SELECT s::BIGINT AS s, 100 + o AS o, 'supplies' AS predicate, count(DISTINCT doc_id) AS weight FROM f WHERE NOT other AND o <> 10 GROUP BY ALL"""
)
def stored_facts(m: Model) -> DataFrame:
    """Facts of named ends; those of another domain or with an unknown end fall out."""
    rows = m.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("supplier").alias("subject_type"), F.concat(F.lit(" S  "), F.pmod("l_suppkey", F.lit(7)).cast("string")).alias("subject_name"), F.lit("supplies").alias("predicate"), F.lit("part").alias("object_type"), F.concat(F.lit("P "), F.pmod("l_partkey", F.lit(11)).cast("string")).alias("object_name"), F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise("home").alias("domain"))
    known = [(k, "supplier", f"s {k}", "home") for k in range(7)] + [(100 + k, "part", f"p {k}", "home") for k in range(10)]
    entities = m.spark.createDataFrame(known, "id bigint, type string, name string, domain string")
    return extract.stored_facts(rows, entities).select(F.col("subject_entity_id").alias("s"), F.col("object_entity_id").alias("o"), "predicate", "weight")


@query(
    """WITH e AS (SELECT n_nationkey AS id, n_name AS name, (n_nationkey % 10) / 10.0 AS c, CASE n_regionkey WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.85 END AS least FROM nation)
SELECT a.id::BIGINT AS id, a.name AS subject_name, b.name AS object_name FROM e a JOIN e b ON b.id = a.id + 1 WHERE a.c >= a.least AND b.c >= b.least"""
)
def published_facts(m: Model) -> DataFrame:
    """Facts between neighbouring nations, both of which reach their domain's confidence."""
    nation = m.table("nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("domain"), (F.pmod("n_nationkey", F.lit(10)) / 10.0).alias("confidence"))
    pairs = nation.alias("a").join(nation.alias("b"), F.col("b.k") == F.col("a.k") + 1)
    facts = pairs.select(F.col("a.k").alias("id"), F.lit("n").alias("subject_type"), F.col("a.name").alias("subject_name"), F.lit("next").alias("predicate"), F.lit("n").alias("object_type"), F.col("b.name").alias("object_name"))
    own = nation.select(F.col("k").alias("id"), "name", F.lit("n").alias("type"), "domain", "confidence")
    entities = own.unionByName(own.withColumn("id", F.col("id") - 1))
    return extract.published(entities, facts, {"1": 0.3, "2": 0.5})[1].select("id", "subject_name", "object_name")


# ---- queue, garbage, vectors -------------------------------------------------------------------------------------


@query(with_("k_events", more=_TASKS) + "SELECT status, count(*) AS n FROM k_tasks GROUP BY status")
def queue_counts(m: Model) -> DataFrame:
    return maintenance.status_counts(_tasks(m))


@query(with_("k_events", more=_TASKS) + "SELECT id, identity FROM k_tasks WHERE starts_with(identity, '2') AND status = 'error'")
def queue_list(m: Model) -> DataFrame:
    return maintenance.listed(_tasks(m), "2", "error").select("id", "identity")


@query(with_("k_events") + "SELECT type, identity, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM (SELECT type, identity, (event_id % 4)::VARCHAR AS i FROM k_events UNION ALL SELECT type, identity, '9' FROM k_events) GROUP BY ALL")
def queue_ids(m: Model) -> DataFrame:
    """The ids of all events of a task are united."""
    rows = m.events().withColumnRenamed("event_id", "order").withColumn("ids", F.array(F.col("order") % 4, F.lit(9).cast("bigint")))
    return maintenance.enqueue(rows).select("type", "identity", F.array_join("ids", ",").alias("ids"))


@query(
    with_("k_events", more=_TASKS)
    + """SELECT id, CASE WHEN id % 7 = 0 THEN 'done' WHEN id % 7 = 1 THEN CASE WHEN attempts = 2 THEN 'error' ELSE 'pending' END ELSE status END AS status, attempts + CASE WHEN id % 7 = 1 THEN 1 ELSE 0 END AS attempts
FROM (SELECT id, CASE WHEN type = 'click' THEN 'doc:delete' ELSE type END AS type, status, attempts FROM k_tasks) WHERE NOT (id % 7 = 0 AND type = 'doc:delete')"""
)
def queue_finished(m: Model) -> DataFrame:
    """Every seventh task is done, the next one failed; deletions that are done leave the queue."""
    tasks = _tasks(m).withColumn("type", F.when(F.col("type") == "click", "doc:delete").otherwise(F.col("type")))
    return maintenance.finished(tasks, tasks.filter("id % 7 = 0").select("id"), tasks.filter("id % 7 = 1").select("id"), 1705000000).select("id", "status", "attempts")


def _counts(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in ("documents", "chunks", "chunk_entities", "entities", "entity_sources", "facts", "fact_sources", "entity_links", "entity_aliases"):
        row = t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    with_("k_docs", "k_chunks", "k_entities", "k_facts", "k_links", more=_ABOUT)
    + """SELECT 'documents' AS name, count(*) AS n FROM k_docs WHERE id % 3 <> 0 UNION ALL SELECT 'chunks', count(*) FROM k_chunks WHERE doc_id % 3 <> 0
UNION ALL SELECT 'chunk_entities', count(*) FROM k_about WHERE doc_id % 3 <> 0 AND entity_id % 2 = 0 UNION ALL SELECT 'entities', count(*) FROM k_entities WHERE id % 2 = 0
UNION ALL SELECT 'entity_sources', count(*) FROM (SELECT DISTINCT doc_id, entity_id FROM k_about WHERE doc_id % 3 <> 0 AND entity_id % 2 = 0) UNION ALL SELECT 'facts', count(*) FROM k_facts
UNION ALL SELECT 'fact_sources', count(*) FROM orders JOIN k_docs ON id = o_orderkey WHERE id % 3 <> 0 UNION ALL SELECT 'entity_links', count(*) FROM k_links WHERE s % 2 = 0 AND o % 2 = 0
UNION ALL SELECT 'entity_aliases', count(*) FROM nation WHERE n_nationkey % 2 = 0"""
)
def cascade_delete(m: Model) -> DataFrame:
    """Rows left in each table when every third document and every second entity go."""
    t = _tables(m)
    t |= {"documents": t["documents"].filter("id % 3 <> 0"), "entities": t["entities"].filter("id % 2 = 0")}
    return _counts(maintenance.cascaded(t))


@query(
    with_("k_docs", "k_chunks", "k_facts", more=_ABOUT)
    + """SELECT 'chunks' AS name, count(*) AS n FROM k_chunks WHERE doc_id <> 7 UNION ALL SELECT 'fact_sources', count(*) FROM orders WHERE o_orderkey <> 7
UNION ALL SELECT 'facts', count(*) FROM k_facts WHERE s NOT IN (SELECT 4000000000 + o_custkey FROM orders WHERE o_orderkey = 7 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey <> 7))
UNION ALL SELECT 'entity_sources', count(*) FROM (SELECT DISTINCT doc_id, entity_id FROM k_about WHERE doc_id <> 7)"""
)
def clear_document(m: Model) -> DataFrame:
    t = _tables(m)
    t["documents"] = t["documents"].select("id").unionByName(m.table("orders").select(F.col("o_orderkey").alias("id"))).distinct()
    return _counts(maintenance.clear_document(t, 7)).filter("name in ('chunks', 'fact_sources', 'facts', 'entity_sources')")


@query(
    with_("k_facts", "k_chunks", "k_docs", more=_ABOUT)
    + """SELECT 'fact' AS what, s AS id FROM k_facts WHERE status <> 'approved' AND s NOT IN (SELECT 4000000000 + o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'document', id FROM k_docs WHERE id NOT IN (SELECT doc_id FROM k_chunks WHERE doc_id % 2 = 0) AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def gc_facts_and_documents(m: Model) -> DataFrame:
    """Facts without a filled order that nobody approved, and documents that neither a chunk of even number nor such an order refers to."""
    sources = m.table("orders").filter("o_orderstatus = 'F'").select((F.lit(CUSTOMER) + F.col("o_custkey")).alias("fact_id"), F.col("o_orderkey").alias("document_id"))
    facts = maintenance.orphan_facts(m.facts(), sources).select(F.lit("fact").alias("what"), "id")
    none = m.spark.createDataFrame([], "document_id bigint")
    docs = maintenance.orphan_documents(m.documents(), m.chunks().filter("doc_id % 2 = 0"), none, sources)
    return facts.unionByName(docs.select(F.lit("document").alias("what"), "id"))


_LOG = "log AS (SELECT event_id % 400 AS chunk_id, event_id AS version, event_id % 9 = 0 AS deleted, value::FLOAT AS value FROM events)"


def _log(m: Model) -> DataFrame:
    return m.table("events").select(F.pmod("event_id", F.lit(400)).alias("chunk_id"), F.col("event_id").alias("version"), (F.col("event_id") % 9 == 0).alias("deleted"), F.array(F.col("value").cast("float")).alias("embedding"))


@query(f"WITH {_LOG} SELECT chunk_id, max(version) AS version, round(arg_max(value, version)::DOUBLE, 4) AS value FROM log GROUP BY 1 HAVING NOT arg_max(deleted, version)")
def vector_compaction(m: Model) -> DataFrame:
    log, done = vectors.maybe_compacted(_log(m))
    rows = vectors.compacted(log) if not done else log
    return rows.select("chunk_id", "version", F.round(F.col("embedding")[0].cast("double"), 4).alias("value"))


@query(f"WITH {_LOG}, s AS (SELECT count(*) AS n, count(*) FILTER (deleted OR version < (SELECT max(version) FROM log x WHERE x.chunk_id = log.chunk_id)) AS stale FROM log) SELECT n AS rows_, stale, stale * 100 > n * 30 AS compact FROM s")
def vector_stale_share(m: Model) -> DataFrame:
    return vectors.stale_share(_log(m)).select(F.col("rows").alias("rows_"), "stale", "compact")


@query(f"WITH {_LOG} SELECT chunk_id FROM (SELECT chunk_id, version, deleted FROM log UNION ALL SELECT 1000 + chunk_id, 10000000, false FROM log UNION ALL SELECT chunk_id, 10000001, true FROM log WHERE chunk_id < 50) GROUP BY 1 HAVING NOT arg_max(deleted, version)")
def vector_ids(m: Model) -> DataFrame:
    """Live ids after an insertion and a deletion."""
    log = _log(m)
    more = log.groupBy("chunk_id").agg(F.first("embedding").alias("embedding")).withColumn("chunk_id", F.col("chunk_id") + 1000)
    grown = vectors.appended(log, more)
    return vectors.ids(vectors.appended(grown, log.filter("chunk_id < 50").select("chunk_id").distinct(), deleted=True))


# ---- functions ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp, floor(epoch(ts))::BIGINT AS seconds FROM events")
def time_stamps(m: Model) -> DataFrame:
    """Seconds as RFC 3339, read back with an offset."""
    rows = m.events().select("event_id", text.rfc3339(F.col("at")).alias("stamp"))
    return rows.select("event_id", "stamp", text.parse_time(F.regexp_replace("stamp", "Z$", ".25+00:00")).alias("seconds"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)))/ sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * (1 + vec_id % 3) * (1 + vec_id % 3)))), 5) AS total FROM embeddings")
def unit_vectors(m: Model) -> DataFrame:
    scaled = m.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v"))
    return scaled.select("vec_id", F.round(F.aggregate(text.l2_normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT event_type, list_sort(list(value))[round((count(*) - 1) * 0.95)::INT + 1] AS p95 FROM events GROUP BY event_type")
def nearest_percentile(m: Model) -> DataFrame:
    return m.table("events").groupBy("event_type").agg(F.collect_list("value").alias("v")).select("event_type", text.percentile_nearest(F.col("v"), 0.95).alias("p95"))
