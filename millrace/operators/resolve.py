"""Entity resolution: batch clusters, candidate tiers, ordered replay, merging."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.text import jaro_winkler, jaro_winkler_py, match_key, match_key_py, normalize, normalize_py, stem_key, stem_key_py
from millrace.operators.components import connected_components

THRESHOLD = 0.8


def _may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether lengths alone allow the similarity: all of the shorter name matched and the full prefix bonus granted."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    jaro = (2 + short / long) / 3
    return jaro + 0.4 * (1 - jaro) >= threshold - 1e-9


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) for pairs of ids of one domain and type that share a bigram and reach the threshold.

    names has (id, domain, type, name). Equal normalized names meet once, by their least id; blocks are equi-joins on
    bigrams, which the planner splits where one is skewed.
    """
    keyed = names.withColumn("key", normalize(F.col("name")))
    one = keyed.groupBy("domain", "type", "key").agg(F.min("id").alias("id"))
    same = keyed.join(one.withColumnRenamed("id", "a"), ["domain", "type", "key"]).filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    grams = one.select("domain", "type", "id", "key", F.explode(text.bigrams(F.col("key"))).alias("gram"))
    a = grams.select("domain", "type", "gram", F.col("id").alias("a"), F.col("key").alias("ka"))
    b = grams.select("domain", "type", "gram", F.col("id").alias("b"), F.col("key").alias("kb"))
    met = a.join(b, ["domain", "type", "gram"]).filter((F.col("a") < F.col("b")) & _may_reach("ka", "kb", threshold)).select("a", "b", "ka", "kb").distinct()
    near = met.withColumn("similarity", jaro_winkler("ka", "kb")).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
    return near.unionByName(same)


def clusters(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, cluster, canonical): components of similar names, equal match keys and equal stem keys within a domain and
    type. A cluster is named by its least id; the canonical name is the longest, of the least id among equals."""
    keyed = names.withColumn("m", match_key(F.col("name"))).withColumn("s", stem_key("name"))

    def by(key: str) -> DataFrame:
        head = keyed.groupBy("domain", "type", key).agg(F.min("id").alias("a"))
        return keyed.join(head, ["domain", "type", key]).filter(F.col("a") != F.col("id")).select("a", F.col("id").alias("b"))

    edges = similar_pairs(names, threshold).select("a", "b").unionByName(by("m")).unionByName(by("s"))
    roots = connected_components(edges, "a", "b")
    placed = names.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    best = placed.groupBy("cluster").agg(F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical"))
    return placed.join(best, "cluster").select("id", "cluster", "canonical")


def candidate_tiers(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, configured: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(mention_id, entity_id, tier): the best known entity of each mention, null where there is none.

    Tiers: 1 equal match key, 2 equal stem key, 3 the configured canonical of the mention's name, 4 a recorded alias of
    an entity of its domain and type, 5 the most similar name among those that share a bigram, from the threshold on.
    Ties go to the least entity id. mentions has (mention_id, domain, type, name), aliases (entity_id, alias).

    Distinct names meet, not rows: the least entity of a name stands for it, and mentions take what their name found. Only
    names that no other tier finds are compared by bigrams.
    """
    spark = mentions.sparkSession
    place = ["domain", "type"]
    m = mentions.select(*place, "name").distinct().withColumn("n", normalize(F.col("name"))).withColumn("m", match_key(F.col("name"))).withColumn("s", stem_key("name"))
    known = entities.select(*place, F.col("id").alias("entity_id"), F.col("name").alias("ename"))
    e = known.groupBy(*place, "ename").agg(F.min("entity_id").alias("entity_id")).withColumn("en", normalize(F.col("ename"))).withColumn("m", match_key(F.col("ename"))).withColumn("s", stem_key("ename"))
    found = lambda df, tier, score=F.lit(0.0): df.select(*place, "name", "entity_id", F.lit(tier).alias("tier"), score.alias("score"))
    rows = found(m.join(e.drop("s"), [*place, "m"]), 1).unionByName(found(m.join(e.drop("m"), [*place, "s"]), 2))
    if configured:
        pairs = spark.createDataFrame([(normalize_py(k), normalize_py(v)) for k, v in configured.items()], "n string, en string")
        rows = rows.unionByName(found(m.join(F.broadcast(pairs), "n").join(e.drop("m", "s"), [*place, "en"]), 3))
    named = aliases.select("entity_id", normalize(F.col("alias")).alias("n"))
    rows = rows.unionByName(found(m.join(named, "n").join(known, [*place, "entity_id"]), 4))
    free = m.join(rows.select(*place, "name").distinct(), [*place, "name"], "left_anti")
    left, right = free.select(*place, "name", "n", F.explode(text.bigrams(F.col("n"))).alias("g")), e.select("entity_id", *place, "en", F.explode(text.bigrams(F.col("en"))).alias("g"))
    met = left.join(right, [*place, "g"]).filter(_may_reach("n", "en", threshold)).select(*place, "name", "entity_id", "n", "en").distinct()
    rows = rows.unionByName(found(met.withColumn("w", jaro_winkler("n", "en")).filter(F.col("w") >= threshold), 5, -F.col("w")))
    best = rows.groupBy(*place, "name").agg(F.min(F.struct("tier", "score", "entity_id")).alias("best"))
    return mentions.select("mention_id", *place, "name").join(best, [*place, "name"], "left").select("mention_id", F.col("best.entity_id").alias("entity_id"), F.col("best.tier").alias("tier"))


@dataclass
class Resolver:
    """Ordered resolution inside one domain and type: what a mention creates or renames is seen by the next.

    Entities are found by their keys and bigrams, so a mention is compared only with names that share one with it.
    """

    threshold: float = THRESHOLD
    configured: dict[str, str] = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)
    aliases: dict[str, int] = field(default_factory=dict)
    places: dict[tuple[str, str], set[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, name in self.names.items():
            self._index(i, name)

    @staticmethod
    def _grams(key: str) -> set[str]:
        return {key[j : j + 2] for j in range(len(key) - 1)} or {key}

    def _keys(self, name: str) -> list[tuple[str, str]]:
        n = normalize_py(name)
        return [("m", match_key_py(name)), ("s", stem_key_py(name)), ("n", n), *(("g", g) for g in self._grams(n))]

    def _index(self, i: int, name: str, old: str | None = None) -> None:
        for k in self._keys(old) if old is not None else ():
            self.places[k].discard(i)
        for k in self._keys(name):
            self.places.setdefault(k, set()).add(i)

    def find(self, name: str) -> tuple[int | None, int]:
        n, at = normalize_py(name), self.places.get
        for tier, key in ((1, ("m", match_key_py(name))), (2, ("s", stem_key_py(name)))):
            if hits := at(key):
                return min(hits), tier
        if n in self.configured and (hits := at(("n", normalize_py(self.configured[n])))):
            return min(hits), 3
        if n in self.aliases:
            return self.aliases[n], 4
        met = set().union(*(at(("g", g), ()) for g in self._grams(n)))
        best = min(((-jaro_winkler_py(n, self.names[i]), i) for i in met), default=(0.0, None))
        return (best[1], 5) if best[1] is not None and -best[0] >= self.threshold else (None, 0)

    def resolve(self, name: str, new_id: int) -> tuple[int, int]:
        """The entity of a mention and the tier that found it, 0 for a new entity of id new_id."""
        found, tier = self.find(name)
        n = normalize_py(name)
        if found is None:
            self.names[new_id] = self.configured.get(n, name)
            self._index(new_id, self.names[new_id])
            found = new_id
        elif len(name) > len(self.names[found]) and tier != 3:
            before = self.names[found]
            self.names[found] = name
            self._index(found, name, before)
            self.aliases.setdefault(normalize_py(before), found)
        if n != normalize_py(self.names[found]):
            self.aliases.setdefault(n, found)
        return found, tier


def replay(mentions: DataFrame, threshold: float = THRESHOLD, configured: dict[str, str] | None = None) -> DataFrame:
    """(mention_id, entity_id, tier, name): mentions resolved in order of mention_id, each domain and type by itself.

    A new entity takes its first mention's id; name is the entity's name after the last mention. This follows one group
    in one task, as each decision needs the ones before; candidate_tiers and clusters are the forms for large groups.
    """
    table = {normalize_py(k): v for k, v in (configured or {}).items()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, resolver = rows.sort_values("mention_id"), Resolver(threshold, table)
        hits = [resolver.resolve(n, int(i)) for i, n in zip(rows["mention_id"], rows["name"], strict=True)]
        return pd.DataFrame({"mention_id": rows["mention_id"], "entity_id": [h[0] for h in hits], "tier": [h[1] for h in hits], "name": [resolver.names[h[0]] for h in hits]})

    return mentions.select("mention_id", "domain", "type", "name").groupBy("domain", "type").applyInPandas(run, "mention_id bigint, entity_id bigint, tier int, name string")


class MergeError(ValueError):
    """Two entities that may not be merged."""


def merge(tables: dict[str, DataFrame], into: int, from_: int) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables after entity from_ became into, and counters.

    tables: entities (id, type, name, domain), facts (id, subject_entity_id, predicate, object_entity_id, ...),
    chunk_entities, entity_sources, entity_links, entity_aliases. A fact of from_ that would repeat an untouched fact
    goes, and of those that become (into, predicate, into) the least id stays; the rest are moved. Moved rows that
    repeat others go, links between the two vanish, and both names become aliases.
    """
    entities = tables["entities"]
    pair = {r["id"]: r for r in entities.filter(F.col("id").isin(into, from_)).collect()}
    for i in (into, from_):
        if i not in pair:
            raise MergeError(f"entity {i} does not exist")
    if into == from_:
        raise MergeError("an entity cannot be merged with itself")
    for what in ("type", "domain"):
        if pair[into][what] != pair[from_][what]:
            raise MergeError(f"{what} mismatch: {pair[into][what]!r} and {pair[from_][what]!r}")
    moved = lambda c: F.when(F.col(c) == from_, F.lit(into).cast("bigint")).otherwise(F.col(c)).alias(c)
    out, n = dict(tables), {}

    facts, ends = tables["facts"], ("subject_entity_id", "object_entity_id")
    touched = F.coalesce(F.col(ends[0]) == from_, F.lit(False)) | F.coalesce(F.col(ends[1]) == from_, F.lit(False))
    mapped = facts.select(*(moved(c) if c in ends else F.col(c) for c in facts.columns), touched.alias("__touched"))
    # facts without an endpoint never repeat one another unless the row they meet is untouched and equally open
    key = Window.partitionBy(*ends, "predicate")
    held = F.max((~F.col("__touched")).cast("int")).over(key) == 1
    loop = F.coalesce((F.col(ends[0]) == into) & (F.col(ends[1]) == into), F.lit(False))
    among = F.row_number().over(Window.partitionBy(*ends, "predicate", "__touched").orderBy("id"))
    judged = mapped.withColumn("__drop", F.col("__touched") & (held | (loop & (among > 1))))
    n["facts_dropped"], n["facts_moved"] = judged.filter("__drop").count(), judged.filter("__touched and not __drop").count()
    out["facts"] = judged.filter("not __drop").select(facts.columns)

    for name, column, keys in (("chunk_entities", "entity_id", ["chunk_id", "entity_id"]), ("entity_sources", "entity_id", ["entity_id", "document_id"])):
        df = tables[name]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__t").cast("int")))
        marked = df.select(*(moved(c) if c == column else F.col(c) for c in df.columns), (F.col(column) == from_).alias("__t"))
        out[name] = marked.withColumn("__r", rank).filter("__r = 1").select(df.columns)

    links, lends = tables["entity_links"], ("subject_entity_id", "target_entity_id")
    marked = links.select(*(moved(c) if c in lends else F.col(c) for c in links.columns), ((F.col(lends[0]) == from_) | (F.col(lends[1]) == from_)).alias("__t"))
    rank = F.row_number().over(Window.partitionBy(*lends, "relation_type").orderBy(F.col("__t").cast("int")))
    out["entity_links"] = marked.filter(F.col(lends[0]) != F.col(lends[1])).withColumn("__r", rank).filter("__r = 1").select(links.columns)

    aliases = tables["entity_aliases"]
    kept = aliases.select(moved("entity_id"), "alias")
    names = entities.sparkSession.createDataFrame([(into, normalize_py(pair[i]["name"])) for i in (from_, into)], "entity_id bigint, alias string").distinct()
    out["entity_aliases"] = kept.unionByName(names.join(kept, "alias", "left_anti").select("entity_id", "alias"))
    out["entities"] = entities.filter(F.col("id") != from_)
    return out, n
