"""Text keys: normalized names, article and stem keys, scripts, bigrams, similarity, folded tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from millrace.functions import stemming

ARTICLES = ("the", "an", "a")


def normalize(name: Column) -> Column:
    """Trimmed, white space runs as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def match_key(name: Column) -> Column:
    """The normalized name without one leading whole-word article; a bare article gives an empty string."""
    return F.regexp_replace(normalize(name), rf"^(?:{'|'.join(ARTICLES)})(?: +|$)", "")


def normalize_py(name: str) -> str:
    return " ".join(name.split()).lower()


def match_key_py(name: str) -> str:
    name = normalize_py(name)
    first, _, rest = name.partition(" ")
    return rest.lstrip() if first in ARTICLES else name


def script_of(text: str) -> str:
    """latin, cyrillic or other, by the first letter."""
    for c in text:
        if c.isalpha():
            if "Ѐ" <= c <= "ԯ":
                return "cyrillic"
            return "latin" if c.isascii() or "À" <= c <= "ʯ" else "other"
    return "other"


def script(text: Column) -> Column:
    first = F.regexp_extract(text, r"(\p{IsAlphabetic})", 1)
    return F.when(first.rlike("^[Ѐ-ԯ]$"), "cyrillic").when(first.rlike("^[A-Za-zÀ-ʯ]$"), "latin").otherwise("other")


def stem_py(text: str) -> str:
    """Each word of a lower-cased text stemmed by its script."""
    by = {"latin": stemming.english, "cyrillic": stemming.russian, "other": str}
    return " ".join(by[script_of(w)](w) for w in text.lower().split())


def stem_key_py(name: str) -> str:
    return stem_py(match_key_py(name))


@pandas_udf(StringType())
def stem_key(names: pd.Series) -> pd.Series:
    """Stemmed match key; repeated names of a batch are stemmed once."""
    unique = {n: None if n is None else stem_key_py(n) for n in names.unique()}
    return names.map(unique)


def bigrams(name: Column) -> Column:
    """Distinct neighbouring pairs of characters of the normalized name, in order; a name of one character is itself."""
    key = normalize(name)
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(F.length(key) < 2, F.array(key)).otherwise(F.array_distinct(pairs))


def jaro_winkler_py(a: str, b: str) -> float:
    """Jaro-Winkler with the prefix bonus always granted and half transpositions counted."""
    a, b = normalize_py(a), normalize_py(b)
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = dict.fromkeys(range(len(b)))
    common, places = [], []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j in free and b[j] == c), None)
        if j is not None:
            del free[j]
            common.append(c)
            places.append(j)
    if not common:
        return 0.0
    m = len(common)
    swapped = sum(x != b[j] for x, j in zip(common, sorted(places), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_py(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _folding() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended with a mark, and their base letters."""
    marked, base = "", ""
    for point in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(point).lower())
        if len(plain) > 1 and plain[0].isalpha() and len(chr(point).lower()) == 1 and chr(point).lower() not in marked:
            marked, base = marked + chr(point).lower(), base + plain[0]
    return marked, base


FOLD_FROM, FOLD_TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_py(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def parse_time(text: Column) -> Column:
    """Seconds since the epoch of `YYYY-MM-DD HH:MM:SS` (UTC) or RFC 3339 with an offset and at most 9 fraction digits;
    null for anything else. Fractions are dropped."""
    bare = r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"
    zoned = r"^\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
    whole = F.upper(F.regexp_replace(text, r"\.\d+", ""))
    bare_time = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX"))
    return F.when(text.rlike(bare), F.unix_seconds(bare_time)).when(text.rlike(zoned), F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def l2_normalize(vector: Column) -> Column:
    """The vector over its double-precision norm; left alone at a norm of 1e-9 or less."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm <= 1e-9, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def percentile_nearest(values: Column, q: float) -> Column:
    """Nearest rank on n - 1 of an array of numbers."""
    return F.element_at(F.array_sort(values), (F.round((F.size(values) - 1) * q) + 1).cast("int"))
