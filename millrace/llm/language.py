"""Language identification by interpolated Kneser-Ney character models kept in sorted arrays of n-gram keys."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import bound_batches, releasing

#: Characters of the longest n-gram; a key packs that many 16-bit code units into 64 bits.
ORDER = 4
#: Documents that the models and the calibration learn from, for each language: the bound of the labelled sample.
TRAIN_DOCS = 1500
CALIBRATION_DOCS = 500
#: Parts that the calibration texts of a language below that bound are left out of its training in.
FOLDS = 4
#: Bits a character by which a text may exceed the worst calibration text of its length before it is rejected.
MARGIN = 0.5
#: Entries and letters of a worker's cache of word scores, which starts anew when either is full; characters scored at
#: once, so that a word of any length takes bounded memory.
CACHE, CACHE_CHARS, PART = 200_000, 8 << 20, 1 << 17
UNDETERMINED = "und"

_START, _END, _ASTRAL = 1, 2, 3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; superscripts, fractions and other numerals that the pattern admits part them."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code units of all words, each with a start and an end mark, and where each word begins."""
    joined = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    codes = np.where(codes > 0xFFFF, _ASTRAL, codes).astype("<u8")
    return codes, np.flatnonzero(codes == _START)


def ngram_keys(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each length n, the key of the n code units that end at a position, 0 where a word begins within them."""
    keys = [codes.copy()]
    # how far a position lies behind its word's start mark
    at = np.arange(len(codes))
    begun = np.maximum.accumulate(np.where(codes == _START, at, 0))
    for n in range(2, order + 1):
        before = np.zeros_like(codes)
        before[n - 1 :] = codes[: len(codes) - n + 1]
        key = keys[-1] | (before << np.uint64(16 * (n - 1)))
        keys.append(np.where(at - begun >= n - 1, key, np.uint64(0)))
    return keys


@dataclass
class Model:
    """keys: sorted n-grams of all languages; cost and back: one column a language, in bits.

    cost[i] is -log2 of the interpolated probability of the last character of key i after the others; back[i] is
    -log2 of the weight that key i, as a context, leaves to shorter contexts (0 if unseen).
    """

    langs: list[str]
    keys: np.ndarray
    cost: np.ndarray
    back: np.ndarray
    unseen: np.ndarray
    ceilings: np.ndarray
    sharpness: float

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (keys != 0)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Bits that each language's model spends on each word and its end mark, PART characters at a time."""
        codes, starts = codes_of(words)
        total = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(codes), PART):
            low = max(0, at - ORDER + 1)
            costs = self._costs(codes[low : at + PART])[at - low :]
            word = np.searchsorted(starts, at, side="right") - 1
            begin = np.append(0, starts[word + 1 : np.searchsorted(starts, at + PART)] - at)
            total[word : word + len(begin)] += np.add.reduceat(costs, begin, axis=0)
        return total

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits for each code unit but start marks; the first ORDER - 1 are exact only where a word begins the part."""
        keys = ngram_keys(codes)
        total = np.zeros((len(codes), len(self.langs)))
        open_ = np.flatnonzero(codes != _START)
        for n in range(ORDER, 0, -1):
            at, hit = self.find(keys[n - 1][open_])
            total[open_[hit]] += self.cost[at[hit]]
            open_ = open_[~hit]
            if n > 1:
                context = keys[n - 2][open_ - 1]
                at, hit = self.find(context)
                total[open_[hit]] += self.back[at[hit]]
        total[open_] += self.unseen
        return total


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """Interpolated Kneser-Ney models from word counts of each language.

    Counts of the highest order and of n-grams that begin a word are occurrences; those of the others are the distinct
    characters seen before them. The discount of an order is n1 / (n1 + 2 n2); the shortest order interpolates with a
    uniform distribution over all characters seen in any language and one more. Without counts the model has no language.
    """
    langs = sorted(counts)
    if not langs:
        none = np.zeros((0, 0))
        return Model([], np.zeros(0, "<u8"), none, none, np.zeros(0), np.full(64, np.inf), 1.0)
    per: list[list[tuple[np.ndarray, np.ndarray]]] = []
    alphabet: set[int] = set()
    for lang in langs:
        words = list(counts[lang])
        codes, starts = codes_of(words)
        weight = np.repeat(np.fromiter(counts[lang].values(), np.int64), np.diff(np.append(starts, len(codes))))
        keys = ngram_keys(codes)
        alphabet.update(np.unique(codes[codes != _START]).tolist())
        orders: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(ORDER, 0, -1):
            use = (keys[n - 1] != 0) & (codes != _START)
            grams, inverse = np.unique(keys[n - 1][use], return_inverse=True)
            seen = np.bincount(inverse, weight[use], len(grams)).astype(np.int64)
            if n < ORDER:
                first = (grams >> np.uint64(16 * (n - 1))) & np.uint64(0xFFFF)
                longer = orders[-1][0]
                kinds, number = np.unique(longer & np.uint64((1 << 16 * n) - 1), return_counts=True)
                at = np.searchsorted(kinds, grams)
                at_ok = (at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == grams)
                continued = np.where(at_ok, number[np.minimum(at, len(kinds) - 1)], 1)
                seen = np.where(first == _START, seen, continued)
            orders.append((grams, seen))
        per.append(orders[::-1])
    keys = np.unique(np.concatenate([g for orders in per for g, _ in orders]))
    contexts = np.unique(np.concatenate([g >> np.uint64(16) for orders in per for g, _ in orders]))
    keys = np.unique(np.concatenate([keys, contexts[contexts != 0]]))
    model = Model(langs, keys, np.zeros((len(keys), len(langs))), np.zeros((len(keys), len(langs))), np.zeros(len(langs)), np.full(64, np.inf), 1.0)
    length = sum((keys >> np.uint64(16 * n) != 0).astype(int) for n in range(ORDER))
    for k, orders in enumerate(per):
        shorter = np.full(len(keys), 1.0 / (len(alphabet) + 1))
        probability, left = np.zeros(len(keys)), np.ones(len(keys))
        for n in range(1, ORDER + 1):
            grams, seen = orders[n - 1]
            one, two = (seen == 1).sum(), (seen == 2).sum()
            discount = one / (one + 2 * two) if one and two else 0.5
            hist, inverse = np.unique(grams >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, seen, len(hist)), np.bincount(inverse, minlength=len(hist))
            rest = discount * kinds / total
            own = np.flatnonzero(length == n)
            context = keys[own] >> np.uint64(16)
            at = np.minimum(np.searchsorted(hist, context), len(hist) - 1)
            known = hist[at] == context
            weight = np.where(known, rest[at], 1.0)
            if n > 1:
                low = np.searchsorted(keys, keys[own] & np.uint64((1 << 16 * (n - 1)) - 1))
                low_ok = keys[np.minimum(low, len(keys) - 1)] == keys[own] & np.uint64((1 << 16 * (n - 1)) - 1)
                shorter_p = np.where(low_ok, probability[np.minimum(low, len(keys) - 1)], 1.0 / (len(alphabet) + 1))
                left[np.searchsorted(keys, hist[hist != 0])] = rest[hist != 0]
            else:
                model.unseen[k] = -np.log2(rest[0] / (len(alphabet) + 1))
                shorter_p = shorter[own]
            hit = np.minimum(np.searchsorted(grams, keys[own]), len(grams) - 1)
            count = np.where(grams[hit] == keys[own], seen[hit], 0)
            direct = np.where(known, np.maximum(count - discount, 0) / total[at], 0.0)
            probability[own] = direct + weight * shorter_p
        model.cost[:, k] = -np.log2(np.maximum(probability, 1e-300))
        model.back[:, k] = -np.log2(left)
    return model


def bucket(chars: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(chars, 1)).astype(int), 0, 63)


def calibrate(model: Model, samples: list[tuple[str, str]], margin: float = MARGIN, apart: Sequence[tuple[Model, list[tuple[str, str]]]] = ()) -> None:
    """Set the rejection ceilings and the sharpness of scores from held-apart labelled texts.

    samples are held apart from model itself; apart holds further ones, each list with the model that has not learned
    them. The ceiling of a length is the highest cross-entropy of any calibration text at least that long, plus the
    margin: a text is rejected only if every model codes it worse than any labelled text of its size was coded. A text
    whose language its model lacks tells nothing.
    """
    costs, chars, truth = [], [], []
    for fitted, texts in [(model, samples), *apart]:
        scorer, columns = Scorer(fitted), [model.langs.index(k) for k in fitted.langs]
        for lang, text in texts:
            if lang not in fitted.langs:
                continue
            bits, n = scorer.entropy(text)
            if n:
                wide = np.full(len(model.langs), np.inf)
                wide[columns] = bits
                costs.append(wide)
                chars.append(n)
                truth.append(model.langs.index(lang))
    if not costs:
        return
    costs, truth = np.array(costs), np.array(truth)
    worst = np.full(64, -np.inf)
    np.maximum.at(worst, bucket(np.array(chars)), costs.min(axis=1))
    ceiling = np.maximum.accumulate(worst[::-1])[::-1]
    model.ceilings = np.where(np.isfinite(ceiling), ceiling, costs.min(axis=1).max()) + margin
    grid = 2.0 ** np.arange(-2, 7)
    spread = costs.min(axis=1, keepdims=True) - costs
    loss = [-np.mean((spread * b)[np.arange(len(truth)), truth] - np.log(np.exp(spread * b).sum(axis=1))) for b in grid]
    model.sharpness = float(grid[int(np.argmin(loss))])


class Scorer:
    """Cross-entropies of texts from word costs that a worker keeps."""

    def __init__(self, model: Model):
        self.model, self.where, self.costs = model, {}, np.zeros((0, len(model.langs)))
        self.used = self.letters = 0

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.where]
        if not new:
            return
        if self.used + len(new) > CACHE or self.letters > CACHE_CHARS:
            self.where, self.costs, self.used, self.letters = {}, self.costs[:0], 0, 0
            new = list(dict.fromkeys(words))
        self.letters += sum(map(len, new))
        costs = np.concatenate([self.model.word_costs(new[at : at + 20000]) for at in range(0, len(new), 20000)])
        if self.used + len(new) > len(self.costs):
            grown = np.zeros((max(2 * len(self.costs), self.used + len(new)), costs.shape[1]))
            grown[: self.used] = self.costs[: self.used]
            self.costs = grown
        self.costs[self.used : self.used + len(new)] = costs
        self.where.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character for each text and language, and the characters (end marks counted); 0 for no letters."""
        bits, chars = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        if not self.model.langs:
            return bits, np.array([sum(map(len, ws)) + len(ws) for ws in map(words_of, texts)], np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            if words := words_of(text):
                held.append((k, words))
                size += len(words)
            if size > CACHE // 2 or k == len(texts) - 1:
                if held:
                    self.learn([w for _, ws in held for w in ws])
                for j, ws in held:
                    ids = np.fromiter(map(self.where.__getitem__, ws), np.int64, len(ws))
                    chars[j] = sum(map(len, ws)) + len(ws)
                    bits[j] = self.costs[ids].sum(axis=0) / chars[j]
                held, size = [], 0
        return bits, chars

    def entropy(self, text: str) -> tuple[np.ndarray, int]:
        bits, chars = self.entropies([text])
        return bits[0], int(chars[0])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Models for all non-null languages of labelled, from a bounded sample of its rows.

    For each language at most about train_docs + calibration_docs rows are used, those with the lowest hash of their
    id, whole. Words of the training rows are counted by language on the executors; the driver gets those counts. A
    language with no more rows than that is learned from all of them, and calibrated by models that leave out a part of
    its calibration rows, each row in one of FOLDS parts (single rows when there are few). Languages are taken to be few:
    the driver holds one row and the plan one branch for each. A language whose texts have no letter is not learned;
    without any labelled letter the model has no language, predicts und and rejects only texts without a letter.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 40)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit({})
    small = {k for k, n in sizes.items() if n <= train_docs + calibration_docs}
    share = lambda docs: {k: int(min(1.0, docs / n) * (1 << 40)) for k, n in sizes.items()}
    learn = share(train_docs) | dict.fromkeys(small, 1 << 40)
    first = learn | dict.fromkeys(small, 0)
    last = share(train_docs + calibration_docs) | {k: v for k, v in share(calibration_docs).items() if k in small}
    limit = lambda t: F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in t.items()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = rows.filter(F.col("h") < limit(learn)).select("lang", "text").mapInArrow(releasing(count), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    table = counted.toArrow()
    for lang, word, n in zip(table["lang"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist(), strict=True):
        counts.setdefault(lang, {})[word] = n
    model = fit({k: dict(sorted(v.items())) for k, v in counts.items()})
    kept = rows.filter((F.col("h") >= limit(first)) & (F.col("h") < limit(last)) & F.col("lang").isin(model.langs or [""])).select("lang", "text", "h").toArrow()
    samples = sorted(zip(kept["h"].to_pylist(), kept["lang"].to_pylist(), kept["text"].to_pylist(), strict=True))
    folds: list[list[tuple[str, str]]] = [[] for _ in range(FOLDS)]
    place: Counter = Counter()
    for _, lang, text in samples:
        if lang in small:
            folds[place[lang] % FOLDS].append((lang, text))
            place[lang] += 1
    apart = []
    for fold in filter(None, folds):
        held: dict[str, Counter] = {}
        for lang, text in fold:
            held.setdefault(lang, Counter()).update(words_of(text))
        rest = {k: {w: n - held[k][w] for w, n in sorted(v.items()) if n > held[k][w]} if k in held else dict(sorted(v.items())) for k, v in counts.items()}
        if rest := {k: v for k, v in rest.items() if v}:
            apart.append((fit(rest), fold))
    calibrate(model, [(lang, text) for _, lang, text in samples if lang not in small], apart=apart)
    return model


def rejections(model: Model, bits: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return (chars == 0) | (bits.min(axis=1) > model.ceilings[bucket(chars)]) if model.langs else chars == 0


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, rejected) for each row of docs, from the text alone.

    lang_pred is the language of the lowest cross-entropy a character, the first by name among equals; und with score
    0 for a null text or one without a letter, and for all texts where the model has no language. score is the calibrated posterior of the choice. rejected is true for
    und and for a text above the calibrated ceiling. Rows are independent; repeated and null ids pass through, an
    empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            bits, chars = scorer.entropies(batch.column(1).to_pylist())
            if model.langs:
                best, low, some = bits.argmin(axis=1), bits.min(axis=1), chars > 0
            else:
                best, low, some = np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits), bool)
            score = np.where(some, 1 / np.exp((low[:, None] - bits) * model.sharpness).sum(axis=1), 0.0)
            names = np.array([*model.langs, UNDETERMINED], object)[np.where(some, best, len(model.langs))]
            rejected = rejections(model, bits, chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that predict() does not reject, with all their columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, where = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(~rejections(shared.value, *scorer.entropies(batch.column(where).to_pylist()))))

    names = [f"c{k}" for k in range(len(docs.columns))]
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    return docs.toDF(*names).mapInArrow(releasing(run), schema).toDF(*docs.columns)
