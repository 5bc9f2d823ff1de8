"""Quality rules as a ledger of failure bits, with versioned policies and ablations over it. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space that ends words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Rule names in the order of their bits. A rule's bit never changes; new rules are added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version: the rules whose failure removes a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, name in enumerate(RULES) if name in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(RULES)))}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs without ASCII white space; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more, from a text's word hashes."""
    windows = F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))))
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(ranked, lambda r: F.filter(r, lambda s, k: (F.get(r, k - 1)["h"] == s["h"]) | F.coalesce(F.get(r, k + 1)["h"] == s["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda s: s["p"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda s, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - s, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def measurements(text: Column) -> dict[str, Column]:
    """Each measurement of a text by name; words are taken from the column `words` made by ledger()."""
    words, whole = F.col("words"), F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): every rule evaluated once, bit k of failed set where rule k fails.

    One row out for each row in, in one narrow stage: no shuffle, so hot sources and repeated rows cost nothing extra.
    A null, empty or blank text has no words and fails few_words. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the filter on a non-deterministic constant is avoided; a two-step projection keeps the split words computed once
    rows = rows.withColumn("words", words_of(F.col("text")))
    measured = rows.select("id", *(c.alias(n) for n, c in measurements(F.col("text")).items()))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str | Policy = "v1") -> DataFrame:
    """Adds kept: true where none of the policy's rules failed. The texts are not read again."""
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(chosen.mask).cast("bigint")) == 0)


def ablations(rows: DataFrame, policy: str | Policy = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    The ledger is first reduced to one row for each distinct bit set (at most 2 to the number of rules).
    """
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(chosen.mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    names = [(n, 1 << k) for k, n in enumerate(RULES) if n in chosen.rules]
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in names))).alias("r")
    each = sets.select("bits", "n", rule).select("bits", "n", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(total(has).alias("n_failed"), total(alone).alias("n_failed_alone"), total((F.col("bits") == 0) | alone).alias("n_kept_without"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM p QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
gap AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS g FROM twice),
rep AS (SELECT rid, sum(g)::BIGINT AS n FROM gap GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
        + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (100 * n_dup_lines > 60 * n_lines)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
