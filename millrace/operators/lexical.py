"""Full-text search: query grammar, postings and BM25."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.functions.text import fold_py, tokens
from millrace.runtime import discard, materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT, MAX_LIMIT = 20, 100

_LEXEME = re.compile(r'\s*(?:(?P<paren>[()])|"(?P<quoted>(?:[^"]|"")*)"(?P<qstar>\s*\*)?|(?P<word>[^\W_]+)(?P<star>\*)?|(?P<bad>\S))')
_RUN = re.compile(r"[^\W_]+")


class QueryError(ValueError):
    """A malformed full-text query."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; of a prefix phrase the last one is a beginning."""

    words: tuple[str, ...]
    prefix: bool = False

    def count(self, found: Column) -> Column:
        """How often the phrase occurs in an array of tokens."""
        fits = lambda x, k: x.startswith(self.words[k]) if self.prefix and k == len(self.words) - 1 else x == self.words[k]
        if len(self.words) == 1:
            return F.size(F.filter(found, lambda x: fits(x, 0)))
        at = F.sequence(F.lit(0), F.size(found) - len(self.words))
        whole = lambda i: reduce(lambda a, b: a & b, (fits(F.get(found, i + k), k) for k in range(len(self.words))))
        return F.when(F.size(found) < len(self.words), 0).otherwise(F.size(F.filter(at, whole)))


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple

    def test(self, hit: Callable[[Phrase], Column]) -> Column:
        if self.kind == "phrase":
            return hit(self.parts[0])
        a, b = (p.test(hit) for p in self.parts)
        return a & b if self.kind == "AND" else a | b if self.kind == "OR" else a & ~b

    def phrases(self) -> list[Phrase]:
        return list(self.parts) if self.kind == "phrase" else [x for p in self.parts for x in p.phrases()]


def parse(query: str) -> Node | None:
    """Words and "phrases" with prefix*, AND, OR, NOT and parentheses; words side by side are joined by AND.

    NOT binds tightest, then AND, then OR. A blank query gives None, a malformed one raises.
    """
    lexemes: list[tuple[str, object]] = []
    for m in _LEXEME.finditer(query):
        if m["bad"]:
            raise QueryError(f"unexpected {m['bad']!r}")
        if m["paren"]:
            lexemes.append((m["paren"], None))
        elif m["word"] in ("AND", "OR", "NOT") and not m["star"]:
            lexemes.append((m["word"], None))
        else:
            words = tuple(_RUN.findall(fold_py(m["word"] if m["word"] is not None else m["quoted"].replace('""', '"'))))
            if words:
                lexemes.append(("phrase", Phrase(words, bool(m["star"] or m["qstar"]))))
    at = 0

    def peek() -> str | None:
        return lexemes[at][0] if at < len(lexemes) else None

    def take() -> tuple[str, object]:
        nonlocal at
        at += 1
        return lexemes[at - 1]

    def primary() -> Node:
        if peek() == "phrase":
            return Node("phrase", (take()[1],))
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise QueryError("missing )")
            take()
            return inner
        raise QueryError(f"unexpected {peek() or 'end of query'}")

    def without() -> Node:
        left = primary()
        while peek() == "NOT":
            take()
            left = Node("NOT", (left, primary()))
        return left

    def both() -> Node:
        left = without()
        while peek() in ("AND", "phrase", "("):
            if peek() == "AND":
                take()
            left = Node("AND", (left, without()))
        return left

    def either() -> Node:
        left = both()
        while peek() == "OR":
            take()
            left = Node("OR", (left, both()))
        return left

    if not lexemes:
        return None
    tree = either()
    if at < len(lexemes):
        raise QueryError(f"unexpected {peek()}")
    return tree


def limited(limit: int) -> int:
    """A limit outside 1 to 100 becomes 20."""
    return limit if 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "search_text") -> DataFrame:
    """(term, id, tf): occurrences of each folded token; counts combine before the shuffle."""
    words = chunks.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"))


def counted(chunks: DataFrame, phrases: list[Phrase], text_col: str = "search_text") -> DataFrame:
    """The other columns of the chunks with __len, their tokens, and __tf0.. how often each phrase occurs."""
    numbers = let(tokens(F.col(text_col)), lambda t: F.struct(F.size(t).alias("len"), *(p.count(t).alias(f"tf{k}") for k, p in enumerate(phrases))))
    rest = [c for c in chunks.columns if c != text_col]
    return chunks.select(*rest, numbers.alias("__c")).select(*rest, F.col("__c.len").alias("__len"), *(F.col(f"__c.tf{k}").alias(f"__tf{k}") for k in range(len(phrases))))


def scored(chunks: DataFrame, query: str, text_col: str = "search_text") -> DataFrame:
    """The columns of the chunks that match, less their text, and bm25: negative, lower is better.

    One scan of the texts counts each phrase of the query in each chunk into a narrow table in the shared folder; one
    global aggregate of it (a row) gives chunk count, average length and document frequencies over the whole index,
    whatever filters follow. No postings are shuffled.
    """
    tree = parse(query)
    if tree is None:
        return chunks.drop(text_col).withColumn("bm25", F.lit(0.0)).limit(0)
    phrases = list(dict.fromkeys(tree.phrases()))
    counts = materialize(counted(chunks, phrases, text_col), "phrases")
    stats = counts.agg(F.count("*").alias("n"), F.avg("__len").alias("avg"), *(F.count_if(F.col(f"__tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))))
    hit = counts.filter(tree.test(lambda p: F.col(f"__tf{phrases.index(p)}") > 0)).crossJoin(F.broadcast(stats))

    def part(k: int) -> Column:
        df, tf = F.col(f"df{k}").cast("double"), F.col(f"__tf{k}").cast("double")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("avg")))

    score = -reduce(lambda a, b: a + b, (part(k) for k in range(len(phrases))))
    out = hit.select(*(c for c in chunks.columns if c != text_col), score.alias("bm25"))
    out._millrace_counts = counts
    return out


def search(chunks: DataFrame, query: str, limit: int = DEFAULT_LIMIT, domain: str | None = None, id_col: str = "chunk_id", text_col: str = "search_text", domains_col: str = "domains") -> DataFrame:
    """(chunk_id, bm25) of the best matches, ties by id. A domain is normalized and compared with the stored values as
    they are; it filters rows after the statistics are taken."""
    found = scored(chunks.select(id_col, text_col, *([domains_col] if domain else [])), query, text_col)
    counts = getattr(found, "_millrace_counts", None)
    if domain:
        found = found.filter(F.array_contains(domains_col, " ".join(domain.split()).lower()))
    best = found.select(F.col(id_col).alias("chunk_id"), "bm25").orderBy("bm25", "chunk_id").limit(limited(limit))
    # MAX_LIMIT rows at most; with them at hand the table of counts can go
    rows = best.collect()
    if counts is not None:
        discard(counts)
    return chunks.sparkSession.createDataFrame(rows, best.schema)
