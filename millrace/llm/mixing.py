"""Mixing sources to target weights by hash thresholds found in histograms; nothing is sorted and no row is sampled away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.quality import words_of
from millrace.runtime import materialize

#: A row's hash has this many bits, refined in equal steps: 36 bits, 4096 buckets a step.
HASH_BITS = 36
STEP_BITS = 12
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times over.
MOST = 3
#: The table of budgets has one row a source; up to this many rows it is broadcast.
BROADCAST_SOURCES = 100_000


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first HASH_BITS bits of the MD5 of id and text: the same on each run and in each engine."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """A non-null key for a source that may be null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, skey, size, h) for each row: the words of the text (null: 0) and the hash that decides about it."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), F.size(words_of(text)).cast("bigint").alias("size"), row_hash(F.col(id_col), text).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target): shares of the total by weight, none above `most` times its source's size.

    A cap binds where the common level exceeds cap / weight; sources ordered by that ratio, the level after k caps is
    what they leave over the other weights, and it holds from the first source whose ratio is not below it. The
    windows run over one row a source.
    """
    sums = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy((F.col("skey") == "-").cast("int"), "skey")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1)
    ranked = sums.withColumn("weight", weight.cast("bigint")).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, everyone = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / heavy).withColumn("rank", F.row_number().over(by_ratio))
    holds = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rank", "level"))
    level = F.min(holds).over(everyone)["level"]
    return levels.withColumn("level", level).select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(skey, source_size, target, copies, below): each row is taken `copies` times, and once more where h < below.

    copies is the whole part of target / source_size; the rest is a budget for the threshold. Sizes are summed by
    source and hash bucket, the bucket in which the budget ends is found, and only its rows are summed again at the
    next 12 bits, down to single hash values; the last value is taken if that ends nearer the budget. Sums combine
    before each shuffle, so a source may hold any part of the rows. Thresholds nest: a larger budget takes the same
    rows and more.
    """
    wanted = targets(rows, weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    now = wanted.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    now = materialize(now.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("base", F.lit(0).cast("bigint")).withColumn("last", F.lit(0).cast("bigint")), "budgets")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = rows.join(now.select("skey", "prefix"), "skey").filter(F.shiftrightunsigned("h", shift + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("skey", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("skey").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).join(now.select("skey", "rest", "base"), "skey").filter(F.col("base") + F.col("upto") > F.col("rest"))
        edge = ends.groupBy("skey").agg(F.min(F.struct("bucket", "upto", "size")).alias("edge"))
        found = now.join(edge, "skey", "left")
        step = found.select(
            "skey", "source_size", "target", "copies", "rest",
            F.coalesce(F.col("edge.bucket"), F.shiftleft(F.col("prefix"), STEP_BITS)).alias("prefix"),
            (F.col("base") + F.coalesce(F.col("edge.upto") - F.col("edge.size"), F.lit(0))).alias("base"),
            F.coalesce(F.col("edge.size"), F.lit(0)).alias("last"),
        )
        now = materialize(step, "budgets")
    nearer = (F.col("last") > 0) & (2 * F.col("base") + F.col("last") <= 2 * F.col("rest"))
    return now.select("skey", "source_size", "target", "copies", (F.col("prefix") + nearer.cast("bigint")).alias("below"))


def _with_budgets(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "skey")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs: taken words, copies counted.

    Null sources form one source, ordered last; null and blank texts have size 0 and take nothing; equal rows share a
    hash and are taken alike; an empty table gives no rows. Other columns are not read.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    chosen = _with_budgets(rows, materialize(budgets(rows, weights, most), "budgets"))
    times = F.col("copies") + (F.col("h") < F.col("below")).cast("bigint")
    return chosen.select("id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as mix() counts it."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    plan = materialize(budgets(rows, weights, most), "budgets").select("skey", "copies", "below")
    packed = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col(source_col)).alias("skey"), row_hash(F.col(id_col), F.col(text_col).cast("string")).alias("h"))
    times = (F.col("copies") + (F.col("h") < F.col("below")).cast("bigint")).cast("int")
    return _with_budgets(packed, plan).filter(times > 0).select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, ((row_number() OVER (ORDER BY skey = '-', skey) - 1) % 3 + 1)::BIGINT AS weight, (3 * source_size)::BIGINT AS cap FROM s),
l AS (SELECT *, cap::DOUBLE / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, (ratio, skey)) FROM l WHERE level <= ratio)) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT skey, h, sum(size)::BIGINT AS size FROM d GROUP BY skey, h),
u AS (SELECT skey, h, size, sum(size) OVER (PARTITION BY skey ORDER BY h)::BIGINT AS upto FROM g),
x AS (SELECT u.skey, u.h, upto <= target - copies * source_size
         OR (upto - size <= target - copies * source_size AND 2 * upto - size <= 2 * (target - copies * source_size) AND size > 0) AS more FROM u JOIN c USING (skey))
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c USING (skey) JOIN x USING (skey, h)
"""
