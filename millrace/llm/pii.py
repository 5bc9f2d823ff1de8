"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels to similar mentions."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches, releasing

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
#: Damping of message passing and the largest change of a message at which it has settled; ROUNDS only ends a cycle that never settles.
ROUNDS, DAMPING, SETTLED = 2000, 0.5, 1e-4
#: Mentions this near to one another, in characters, are neighbours in the chain.
NEAR = 40
#: Digits at the end of a number that make two mentions similar; numbers and mail names of any length are alike if equal.
TAIL = 7

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9])++")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?[\[(] ?at ?[\])] ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]{1,63}){1,8})", re.IGNORECASE)
_NAMES = re.compile(r"[A-Za-z0-9._%+-]+")
_BEFORE = re.compile(r"([^\W\d_]+)\W*\Z")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Maximal names before each @ that a domain follows; found from the @, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns that pass their tests, by start and then kind."""
    if not _ANY.search(text):
        return []
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


@dataclass
class Mention:
    start: int
    end: int
    key: str
    base: int = -1
    features: list[str] = field(default_factory=list)


def _key(value: str) -> str:
    return value.lower() if "@" in value else _digits(value)[-TAIL:]


def _features(text: str, m: Mention) -> list[str]:
    """What a mention looks like, without what the base patterns themselves test."""
    value = text[m.start : m.end]
    before = _BEFORE.search(text[max(0, m.start - 24) : m.start])
    return [f"digits={min(len(_digits(value)), 20)}", f"marks={''.join(sorted({c for c in value if not c.isalnum()}))[:6]}", f"word={before[1].lower() if before else ''}", f"letters={any(c.isalpha() for c in value)}"]


@dataclass
class Known:
    """What the base spans of a document are: mail names and the address of each, whole digits, keys and their kinds."""

    names: dict[str, str]
    equal: set[str]
    kinds: dict[str, int]

    @staticmethod
    def of(text: str, spans: list[Span]) -> Known:
        names = {text[s:e].partition("@")[0].lower(): text[s:e].lower() for s, kind, e in spans if kind == 0}
        return Known(names, {_digits(text[s:e]) for s, kind, e in spans if kind}, {_key(text[s:e]): kind for s, kind, e in spans})


def mentions(text: str, spans: list[Span], known: Known | None = None) -> list[Mention]:
    """Nodes of a document's field in order: base spans, and numbers, spelt-out addresses and mail names outside them.

    A number whose digits, or a name whose letters, equal those of a base span is always one. Other numbers need enough
    digits to be similar to a base span by their end. known holds the base spans to compare with, these by default.
    """
    known = known or Known.of(text, spans)
    out = [Mention(s, e, _key(text[s:e]), kind) for s, kind, e in spans]
    covered = sorted((s, e) for s, _, e in spans)
    starts, reach = [s for s, _ in covered], []
    for _, e in covered:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(s: int, e: int) -> bool:
        k = bisect_right(starts, s)
        return (not k or reach[k - 1] <= s) and (k == len(starts) or starts[k] >= e)

    names = known.names
    if names:
        for m in _NAMES.finditer(text):
            # a run may end a sentence or stand between dashes
            for name in (m[0], m[0].strip("._%+-")):
                start = m.start() + m[0].find(name)
                if (key := names.get(name.lower())) and free(start, start + len(name)):
                    out.append(Mention(start, start + len(name), key))
                    break
    equal = known.equal
    for m in _NUMBER.finditer(text):
        digits = _digits(m[0])
        if (digits in equal or (m.end() - m.start() <= 48 and TAIL <= len(digits) <= 19)) and free(m.start(), m.end()):
            out.append(Mention(m.start(), m.end(), _key(m[0])))
    if "at]" in (low := text.lower()) or "at)" in low or "at ]" in low or "at )" in low:
        for m in _SPELT.finditer(text):
            if free(m.start(), m.end()):
                domain = re.sub(r" ?[\[(] ?dot ?[\])] ?", ".", m[2], flags=re.IGNORECASE)
                out.append(Mention(m.start(), m.end(), f"{m[1]}@{domain}".lower()))
    out.sort(key=lambda m: (m.start, m.base < 0, m.base, -m.end))
    kept: list[Mention] = []
    for m in out:
        if m.base >= 0 or not kept or kept[-1].base >= 0 or kept[-1].end <= m.start:
            m.features = _features(text, m)
            kept.append(m)
    return kept


def edges_of(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): neighbours in the text; each mention with the next one like it, and each outside the base patterns
    with the nearest base mention like it as well, so both grow with the nodes and no repeat hangs on the others alone."""
    chain = [(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1].start - nodes[k].end <= NEAR]
    skip, last, before, after, behind = {}, {}, {}, {}, {}
    for k, m in enumerate(nodes):
        if m.key:
            if m.key in last:
                skip[last[m.key], k] = None
            last[m.key] = k
            if m.base >= 0:
                before[m.key] = k
            elif m.key in before:
                behind[k] = before[m.key]
    for k in range(len(nodes) - 1, -1, -1):
        m = nodes[k]
        if m.base >= 0:
            after[m.key] = k
        elif m.key:
            near = [b for b in (behind.get(k), after.get(m.key)) if b is not None]
            if near:
                b = min(near, key=lambda b: max(m.start - nodes[b].end, nodes[b].start - m.end))
                skip[min(b, k), max(b, k)] = None
    return chain, list(skip)


def grade(text: str, m: Mention, known: Known) -> str:
    """How a mention is like the base spans of its key: by a mail name, whole digits, the last digits or an address, and
    how telling that is by itself: the length and make of the name, or the number of digits."""
    value = text[m.start : m.end]
    if "@" in m.key:
        if value.lower() in known.names:
            return f"name {min(len(value), 9)} {'letters' if value.isalpha() else 'mixed'}"
        return "address"
    digits = _digits(value)
    return f"{'whole' if digits in known.equal else 'end'} {min(len(digits), 12)}"


@dataclass
class Potentials:
    """Log potentials over the labels none and KINDS; grades has how much mentions alike in some way share, skip that of
    other ways."""

    feature: dict[str, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    skip: float
    grades: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def of(counts: Counter) -> Potentials:
        """From counts of ("label", l), ("f", feature, l), ("chain", l, m), ("skip", same), ("own", grade) and ("other",
        grade): log ratios, add-one smoothed.

        Mentions like no base span count as none. How much mentions alike share starts from the log odds that linked
        base mentions agree, and is fitted for each grade to how often such mentions stand in a document of the base
        span (own) against one without it (other): what is found as often elsewhere tells nothing.
        """
        n = len(KINDS) + 1
        label = np.array([counts["label", k] for k in range(n)], float) + 1
        features = {k[1] for k in counts if k[0] == "f"}
        feature = {f: np.log((np.array([counts["f", f, k] for k in range(n)]) + 1) / (label + 2)) for f in features}
        chain = np.array([[counts["chain", a, b] for b in range(n)] for a in range(n)]) + 1.0
        chain = np.log(chain / chain.sum()) - np.log(np.outer(chain.sum(axis=1), chain.sum(axis=0)) / chain.sum() ** 2)
        skip = float(np.clip(np.log((counts["skip", 1] + 20) / (counts["skip", 0] + 1)), 1.0, 8.0))
        ways = {k[1] for k in counts if k[0] in ("own", "other")}
        grades = {g: float(np.clip(np.log((counts["own", g] + np.exp(skip)) / (counts["other", g] + 1)), 0.0, 8.0)) for g in ways}
        return Potentials({f: v - v[0] for f, v in feature.items()}, np.log(label / label[0]), np.clip(chain, -1, 1), skip, grades)

    def alike(self, ways: list[str]) -> np.ndarray:
        """The table of a skip edge for each way in which its mention is alike."""
        return np.array([self.grades.get(g, self.skip) for g in ways])[:, None, None] * np.eye(len(KINDS) + 1)

    def unary(self, m: Mention) -> np.ndarray:
        """A base mention keeps its label, however many like it speak against. The shape of another speaks against any label by half a unit at least, so
        only mentions like it can give it one."""
        if m.base >= 0:
            return np.where(np.arange(len(KINDS) + 1) == m.base + 1, 0.0, -np.inf)
        score = np.clip(self.prior + sum((self.feature[f] for f in m.features if f in self.feature), np.zeros(len(self.prior))), -2.0, -0.5)
        score[0] = 0.0
        return score


def propagate(unary: np.ndarray, pairs: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label posteriors by damped loopy sum-product, run until the messages settle; tables[k][a][b] is the log potential of pairs[k] = (a's node, b's)."""
    if not len(pairs):
        belief = unary
    else:
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        table = np.concatenate([tables, tables.transpose(0, 2, 1)])
        half = len(pairs)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, unary.shape[1]))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            sent = belief[source] - message[back]
            new = np.logaddexp.reduce(sent[:, :, None] + table, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def added_spans(text: str, spans: list[Span], potentials: Potentials) -> list[Span]:
    """Spans that the field gives a label beyond the base ones; none without a base span to be similar to."""
    if not spans:
        return []
    known = Known.of(text, spans)
    nodes = mentions(text, spans, known)
    if all(m.base >= 0 or m.key not in known.kinds for m in nodes):
        return []
    posterior = propagate(*field_of(text, nodes, known, potentials))
    best = posterior.argmax(axis=1)
    return [(m.start, int(best[k]) - 1, m.end) for k, m in enumerate(nodes) if m.base < 0 and best[k] and posterior[k, best[k]] > 0.5]


def field_of(text: str, nodes: list[Mention], known: Known, potentials: Potentials) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary potentials, pairs and pair tables of a document. A skip edge weighs as much as its weaker mention is alike."""
    chain, skip = edges_of(nodes)
    ways = ["" if m.base >= 0 else grade(text, m, known) for m in nodes]
    share = lambda a, b: min((w for w in (ways[a], ways[b]) if w), key=lambda w: potentials.grades.get(w, potentials.skip), default="")
    pairs = np.array(chain + skip).reshape(-1, 2)
    tables = np.concatenate([np.repeat(potentials.chain[None], len(chain), 0), potentials.alike([share(a, b) for a, b in skip]).reshape(-1, len(KINDS) + 1, len(KINDS) + 1)])
    return np.array([potentials.unary(m) for m in nodes]), pairs, tables


def train(docs: DataFrame, text_col: str = "text") -> Potentials:
    """Potentials counted on all documents, whole texts; the driver gets the counts.

    Each document with base spans is compared with the document read before it in its task as well: mentions there that
    are like a base span which that document does not hold are chance.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        before = ""
        for batch in batches:
            for text in batch.column(0).to_pylist():
                other, before = before, text
                if not (spans := base_spans(text)):
                    continue
                known = Known.of(text, spans)
                nodes = mentions(text, spans, known)
                found.update(("own", grade(text, m, known)) for m in nodes if m.base < 0 and m.key in known.kinds)
                theirs = base_spans(other)
                held = Known.of(other, theirs).kinds
                found.update(("other", grade(other, m, known)) for m in mentions(other, theirs, known) if m.base < 0 and m.key in known.kinds and m.key not in held)
                # a mention like a base span may be one of its kind: it is no example of none
                nodes = [m for m in nodes if m.base >= 0 or m.key not in known.kinds]
                chain, skip = edges_of(nodes)
                for m in nodes:
                    found["label", m.base + 1] += 1
                    found.update(("f", f, m.base + 1) for f in m.features if not f.startswith("word=") or len(f) < 20)
                found.update(("chain", nodes[a].base + 1, nodes[b].base + 1) for a, b in chain)
                found.update(("skip", int(nodes[a].base == nodes[b].base)) for a, b in skip if nodes[a].base >= 0 and nodes[b].base >= 0)
        keys = ["\x00".join(map(str, k)) for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    table = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(count), "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts: Counter = Counter()
    for key, n in zip(table["key"].to_pylist(), table["n"].to_pylist(), strict=True):
        name, *rest = key.split("\x00")
        counts[(name, rest[0], int(rest[1])) if name == "f" else (name, rest[0]) if name in ("own", "other") else (name, *map(int, rest))] = n
    return Potentials.of(counts)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, potentials: Potentials, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs.

    The counts and the hash are of base spans, in code points; spans lists those and the added ones. A null or empty
    text has none. Rows are independent: repeated and null ids pass through, an empty table gives no rows, other
    columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(potentials)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                more = added_spans(text or "", spans, shared.value)
                rows.append([*(sum(k == kind for _, k, _ in spans) for kind in range(4)), hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + more), len(more)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind, as <EMAIL>."""
    out, done, at = [], 0, 0
    ordered = sorted(spans)
    while at < len(ordered):
        start, kind, end = ordered[at]
        at += 1
        while at < len(ordered) and ordered[at][0] < end:
            end = max(end, ordered[at][2])
            at += 1
        out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, potentials: Potentials, text_col: str = "text") -> DataFrame:
    """docs with all found spans of text_col masked; every row and every other column stays, null texts stay null."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, where = spark.sparkContext.broadcast(potentials), docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, spans + added_spans(t, spans, shared.value)) if (spans := base_spans(t)) else t for t in batch.column(where).to_pylist()]
            columns = list(batch.columns)
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {'string' if k == where else t}" for k, (n, t) in enumerate(zip(names, (t for _, t in docs.dtypes), strict=True)))
    return docs.toDF(*names).mapInArrow(releasing(run), schema).toDF(*docs.columns)
