"""Reciprocal rank fusion, standalone legs and reranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 20
RRF_SHARE, BM25_SHARE = 0.7, 0.3
DOUBLE_MAX = 1.7976931348623157e308


def _spread(value: Column, over: Window) -> tuple[Column, Column]:
    return F.min(value).over(over), F.max(value).over(over)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K, top_n: int = 0) -> DataFrame:
    """(chunk_id, score, source_type) from (chunk_id, bm25) and (chunk_id, distance), best first.

    Each leg is ranked by its score and then id; a rank gives 1 / (k + rank). The sums are scaled to 0..1 over all
    candidates, bm25 to 1..0 over the lexical ones (0.5 for others); a spread of zero gives 0.5. Ranks and scales run
    over the legs' rows, at most twice their limits. k below 1 becomes 20; top_n below 1 keeps all.
    """
    k = k if k > 0 else RRF_K
    lex = lexical.select("chunk_id", "bm25", F.row_number().over(Window.orderBy("bm25", "chunk_id")).alias("lr"))
    sem = semantic.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("sr"))
    both = lex.join(sem, "chunk_id", "full_outer")
    everyone = Window.partitionBy(F.lit(1))
    raw = F.coalesce(1.0 / (k + F.col("lr")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("sr")), F.lit(0.0))
    rows = both.withColumn("raw", raw)
    low, high = _spread(F.col("raw"), everyone)
    rrf = F.when(high == low, 0.5).otherwise((F.col("raw") - low) / (high - low))
    worst_low, worst_high = _spread(F.col("bm25"), everyone)
    bm25 = F.when(F.col("bm25").isNull() | (worst_high == worst_low), 0.5).otherwise(1 - (F.col("bm25") - worst_low) / (worst_high - worst_low))
    kind = F.when(F.col("sr").isNull(), "lexical").when(F.col("lr").isNull(), "semantic").otherwise("hybrid")
    found = rows.select("chunk_id", (RRF_SHARE * rrf + BM25_SHARE * bm25).alias("score"), kind.alias("source_type")).orderBy(F.desc("score"), "chunk_id")
    return found.limit(top_n) if top_n > 0 else found


def standalone(leg: DataFrame, kind: str) -> DataFrame:
    """One leg alone: score 1 / its own score, so negative for bm25; a zero gives the largest double."""
    value = "bm25" if kind == "lexical" else "distance"
    score = F.when(F.col(value) == 0, F.lit(DOUBLE_MAX)).otherwise(1 / F.col(value))
    return leg.select("chunk_id", score.alias("score"), F.lit(kind).alias("source_type"), F.row_number().over(Window.orderBy(value, "chunk_id")).alias("prior"))


@dataclass(frozen=True)
class Boosts:
    """Factors on scores; values of zero or less keep the defaults."""

    deprecated: float = 0.2
    official: float = 1.5
    expired: float = 0.1
    fresh: float = 1.2
    fresh_days: int = 90
    authority: dict[str, float] = field(default_factory=dict)

    def value(self, name: str) -> float:
        got = getattr(self, name)
        return got if got > 0 else Boosts.__dataclass_fields__[name].default


def rerank(results: DataFrame, as_of: int, boosts: Boosts = Boosts()) -> DataFrame:
    """results with score boosted and rank from 1, ordered by the new score and then the prior order.

    Reads is_deprecated, is_official (booleans), valid_to and updated_at (epoch seconds), doc_source_type and prior.
    as_of takes the place of the clock: expired means valid_to < as_of, fresh updated_at > as_of - days.
    """
    factor = lambda test, name: F.when(F.coalesce(test, F.lit(False)), boosts.value(name)).otherwise(1.0)
    score = F.col("score") * factor(F.col("is_deprecated"), "deprecated") * factor(F.col("is_official"), "official") * factor(F.col("valid_to") < as_of, "expired")
    score = score * factor(F.col("updated_at") > as_of - boosts.value("fresh_days") * 86400, "fresh")
    if boosts.authority:
        table = F.create_map(*(F.lit(x) for kv in boosts.authority.items() for x in kv))
        score = score * F.coalesce(F.try_element_at(table, F.coalesce("doc_source_type", F.lit(""))), F.lit(1.0))
    again = results.withColumn("score", score)
    return again.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "prior"))).orderBy("rank")
