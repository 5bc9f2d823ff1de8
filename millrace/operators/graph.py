"""The property graph: building, finding, bounded traversal, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalize
from millrace.runtime import discard, materialize

DEPTH, MAX_DEPTH, NODES = 5, 10, 1000
#: Nodes reached so far up to which a walk broadcasts them; beyond, they are shuffled.
BROADCAST = 100_000


def nodes(entities: DataFrame) -> DataFrame:
    """(id, type, name, domain, name_key, domain_key)."""
    return entities.select("id", "type", "name", "domain", normalize(F.col("name")).alias("name_key"), normalize(F.coalesce("domain", F.lit(""))).alias("domain_key"))


def edges(entities: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """(from_id, to_id, relation, kind): approved facts between known entities, then links between them."""
    ids = entities.select("id")
    known = lambda df: df.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    facts = facts.filter(F.col("status") == "approved").select(F.col("subject_entity_id").alias("from_id"), F.col("object_entity_id").alias("to_id"), F.col("predicate").alias("relation"), F.lit("fact").alias("kind"))
    links = links.select(F.col("subject_entity_id").alias("from_id"), F.col("target_entity_id").alias("to_id"), F.col("relation_type").alias("relation"), F.lit("link").alias("kind"))
    return known(facts).unionByName(known(links)).select("from_id", "to_id", "relation", "kind")


def find_exact(graph: DataFrame, name: str, domain: str = "") -> DataFrame:
    """The node of least id with the key domain:name, both normalized."""
    key = " ".join(name.split()).lower(), " ".join(domain.split()).lower()
    return graph.filter((F.col("name_key") == key[0]) & (F.col("domain_key") == key[1])).orderBy("id").limit(1)


def find_partial(graph: DataFrame, query: str, limit: int, domain: str | None = None) -> DataFrame:
    """Nodes whose name holds the query: exact names first, then beginnings, then others; by name and id within."""
    query = " ".join(query.split()).lower()
    if not query:
        raise ValueError("the query is empty")
    found = graph.filter(F.contains("name_key", F.lit(query)))
    if domain:
        found = found.filter(F.col("domain_key") == " ".join(domain.split()).lower())
    tier = F.when(F.col("name_key") == query, 0).when(F.startswith("name_key", F.lit(query)), 1).otherwise(2)
    return found.withColumn("tier", tier).orderBy("tier", "name", "id").limit(limit)


def nodes_by_type(graph: DataFrame, kind: str) -> DataFrame:
    return graph.filter(F.col("type") == kind).orderBy("id")


@dataclass(frozen=True)
class Options:
    max_depth: int = 0
    max_nodes: int = 0
    direction: str = "both"
    relations: tuple[str, ...] = ()
    follow_links: bool = False


def steps(graph_edges: DataFrame, options: Options) -> DataFrame:
    """(parent, node, from_id, to_id, relation, kind, order): how an edge may be walked; facts before links."""
    allowed = graph_edges if options.follow_links else graph_edges.filter(F.col("kind") == "fact")
    if options.relations:
        allowed = allowed.filter(F.col("relation").isin(*options.relations))
    allowed = allowed.withColumn("order", (F.col("kind") == "link").cast("int"))
    out = allowed.select(F.col("from_id").alias("parent"), F.col("to_id").alias("node"), "*")
    back = allowed.select(F.col("to_id").alias("parent"), F.col("from_id").alias("node"), "*")
    return {"out": out, "in": back, "both": out.unionByName(back)}[options.direction]


def traverse(graph: DataFrame, graph_edges: DataFrame, start: int, options: Options = Options(), goal: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from start: nodes (id, depth) and the discovery edges (from_id, to_id, relation, kind, depth).

    A level's nodes are taken in ascending id. A node belongs to the first parent, facts before links, that reaches it,
    and only facts and links into the start node's domain count, unless links are followed: those may leave it. The
    start counts towards max_nodes; what would exceed it ends the walk. Depth 0 is 5, at most 10; 0 nodes is 1000. With a
    goal the walk ends after the level that reaches it. Each
    level is one shuffle join, its new nodes written to the shared folder; only a level that exceeds max_nodes is sorted.
    """
    spark = graph.sparkSession
    depth_limit = min(options.max_depth or DEPTH, MAX_DEPTH)
    room = max(0, (options.max_nodes or NODES) - 1)
    origin = graph.filter(F.col("id") == start).select("domain_key").first()
    if origin is None:
        raise ValueError(f"no node {start}")
    walks = steps(graph_edges, options)
    homes = graph.select(F.col("id").alias("node"), "domain_key")
    seen = spark.createDataFrame([(start, 0)], "id bigint, depth int")
    frontier, found, size = seen, None, 1
    for depth in range(1, depth_limit + 1):
        small = F.broadcast if size <= BROADCAST else (lambda df: df)
        reached = walks.join(small(frontier.select(F.col("id").alias("parent"))), "parent").join(small(seen.select(F.col("id").alias("node"))), "node", "left_anti")
        inside = reached.join(homes, "node").filter((F.col("domain_key") == origin["domain_key"]) | (F.col("kind") == "link"))
        least = F.min(F.struct("parent", "order", "from_id", "to_id", "relation", "kind")).alias("step")
        level = materialize(inside.groupBy("node").agg(least).select("node", "step.*", F.lit(depth).alias("depth")), "level")
        n, met = level.agg(F.count("*"), F.coalesce(F.max(F.col("node") == F.lit(goal).cast("bigint")), F.lit(False))).first()
        if n > room:
            whole, n = level, room
            level = materialize(whole.orderBy("parent", "order", "from_id", "to_id", "relation").limit(room), "level")
            discard(whole)
        if not n:
            break
        room, size = room - n, size + n
        frontier = level.select(F.col("node").alias("id"), "depth")
        seen = seen.unionByName(frontier)
        step = level.select("from_id", "to_id", "relation", "kind", "depth")
        found = step if found is None else found.unionByName(step)
        if room <= 0 or met:
            break
    return seen, found if found is not None else spark.createDataFrame([], "from_id bigint, to_id bigint, relation string, kind string, depth int")


def traverse_many(graph: DataFrame, graph_edges: DataFrame, starts: DataFrame, options: Options = Options()) -> DataFrame:
    """(origin, from_id, to_id, relation, kind, depth): the discovery edges of traverse() from each id of the one-column
    table starts, all walked level by level together; ids that are no node have none."""
    spark = graph.sparkSession
    depth_limit = min(options.max_depth or DEPTH, MAX_DEPTH)
    room = (options.max_nodes or NODES) - 1
    walks, homes = steps(graph_edges, options), graph.select(F.col("id").alias("node"), "domain_key")
    origins = graph.join(starts.toDF("id").distinct(), "id", "left_semi").select(F.col("id").alias("origin"), F.col("domain_key").alias("home"))
    seen = frontier = materialize(origins.select("origin", "home", F.col("origin").alias("node")), "origins")
    found = None
    for depth in range(1, depth_limit + 1):
        reached = walks.join(frontier.withColumnRenamed("node", "parent"), "parent").join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        inside = reached.join(homes, "node").filter((F.col("domain_key") == F.col("home")) | ((F.col("kind") == "link") & F.lit(options.follow_links)))
        first = F.row_number().over(Window.partitionBy("origin", "node").orderBy("parent", "order", "from_id", "to_id", "relation"))
        level = inside.withColumn("r", first).filter("r = 1")
        # what exceeds the bound of an origin ends its walk
        used = seen.groupBy("origin").agg((F.count("*") - 1).alias("used"))
        place = F.row_number().over(Window.partitionBy("origin").orderBy("parent", "order", "from_id", "to_id", "relation"))
        level = level.withColumn("place", place).join(used, "origin").filter(F.col("used") + F.col("place") <= room)
        level = materialize(level.select("origin", "home", "node", "from_id", "to_id", "relation", "kind", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        frontier = level.select("origin", "home", "node")
        seen = seen.unionByName(frontier)
        step = level.select("origin", "from_id", "to_id", "relation", "kind", "depth")
        found = step if found is None else found.unionByName(step)
    return found if found is not None else spark.createDataFrame([], "origin bigint, from_id bigint, to_id bigint, relation string, kind string, depth int")


def path_exists(graph: DataFrame, graph_edges: DataFrame, start: int, end: int, depth: int, direction: str = "both") -> bool:
    """Whether end lies within depth steps of start, with links followed; a node reaches itself; depth is cut to 0..10."""
    depth = max(0, min(depth, MAX_DEPTH))
    if start == end:
        return True
    ends = F.countDistinct(F.when(F.col("id").isin(start, end), F.col("id")))
    if depth == 0 or graph.agg(ends).first()[0] < 2:
        return False
    reached, _ = traverse(graph, graph_edges, start, Options(max_depth=depth, max_nodes=2**31 - 1, direction=direction, follow_links=True), goal=end)
    return not reached.filter(F.col("id") == end).isEmpty()


def neighbors(graph_edges: DataFrame) -> DataFrame:
    """(id, neighbors): distinct adjacent ids of every node in ascending order, both directions, all kinds."""
    both = graph_edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(graph_edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    return both.distinct().groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("neighbors"))


def stats(graph: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """(nodes, edges, average_degree): the degree is twice the edges over the nodes."""
    n, e = graph.agg(F.count("*").alias("nodes")), graph_edges.agg(F.count("*").alias("edges"))
    degree = F.when(F.col("nodes") == 0, 0.0).otherwise(2.0 * F.col("edges") / F.col("nodes"))
    return n.crossJoin(e).withColumn("average_degree", degree)


def to_dot(graph: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """(line_no, line): Graphviz text, one row a line."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    names: Column = F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" [label="), quote(F.col("name")), F.lit("];"))
    arrows = F.concat(F.lit("  "), F.col("from_id").cast("string"), F.lit(" -> "), F.col("to_id").cast("string"), F.lit(" [label="), quote(F.col("relation")), F.lit("];"))
    spark = graph.sparkSession
    ends = spark.createDataFrame([(0, "digraph knowledge {"), (3, "}")], "part int, line string").select("part", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c"), "line")
    body = graph.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c"), names.alias("line")).unionByName(graph_edges.select(F.lit(2).alias("part"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("relation").alias("c"), arrows.alias("line")))
    return ends.unionByName(body).orderBy("part", "a", "b", "c").select("line")
