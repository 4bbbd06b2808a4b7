"""Text normalizers and comparisons, as built-in expressions where Spark has them and Pandas UDFs elsewhere."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that questions are rid of.
STOPWORDS = frozenset("the and for are was were what which who how why when where does did has have had this that these those with from into about between can could should would will not you your our their its it is in on of to a an do be by or as at".split())


def normalize_id(text: str | None) -> str | None:
    """FN1: NFKC, runs of other than letters and digits to one underscore, case-folded, without outer underscores."""
    if text is None:
        return None
    out = re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", text)).lower().strip("_")
    return out.casefold()


def normalized_label(text: str | None) -> str:
    """FN11: NFKC, case-folded, runs of other than letters and digits to one space."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return re.sub(r"[\W_]+", " ", folded).strip()


def search_text(text: str | None) -> str:
    """FN7: NFKD without marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def search_tokens(text: str | None) -> list[str]:
    """FN4: words of letters, digits and underscores of search_text."""
    return re.findall(r"\w+", search_text(text))


def affected_label(text: str | None) -> str:
    """FN34: NFC in lower case; accents stay."""
    return unicodedata.normalize("NFC", text or "").lower()


def query_terms(question: str) -> list[str]:
    """FN5, FN6: a question's words; short ASCII words and stop words go, unless nothing else is there; Han words also in pairs."""
    found: list[str] = []
    for word in re.findall(r"\w+", question.lower()):
        han = any("一" <= c <= "鿿" for c in word)
        for term in ([word[i : i + 2] for i in range(len(word) - 1)] if han and len(word) > 2 else []) + [word]:
            if (not re.fullmatch("[a-z]*", term) or len(term) > 2) and term not in found:
                found.append(term)
    return [t for t in found if t not in STOPWORDS] or found


@F.pandas_udf(T.StringType())
def normalize_id_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_id)


@F.pandas_udf(T.StringType())
def normalized_label_udf(s: pd.Series) -> pd.Series:
    return s.map(normalized_label)


@F.pandas_udf(T.StringType())
def search_text_udf(s: pd.Series) -> pd.Series:
    return s.map(search_text)


def ascii_search_text(c: Column) -> Column:
    """search_text for labels known to be ASCII, as a built-in expression."""
    return F.lower(c)


def entropy(text: Column) -> Column:
    """FN12: Shannon entropy in bits a character of a normalized text, 0 for an empty one."""
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    parts = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda c: c == k)) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def shingles(text: Column, k: int = 3) -> Column:
    """FN8, FN13: distinct runs of k characters; a shorter text is one."""
    many = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(F.length(text) < k, F.array(text)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    """FN14: shared of all elements; two empty sets are alike."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / all_)


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity that a common start of up to four characters raises."""
    score = jaro(a, b)
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return score + start * scale * (1 - score) if score > 0.7 else score


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with adjacent swaps."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, q = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][q] + i - k - 1 + 1 + j - q - 1)
        last[x] = i
    return d[-1][-1]


_VARIANT = re.compile(r"(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})", re.S)


def is_variant_pair(a: str, b: str) -> bool:
    """FN17: short labels of one stem with different endings."""
    if a == b or max(len(a), len(b)) >= 12:
        return False
    x, y = _VARIANT.fullmatch(a), _VARIANT.fullmatch(b)
    return bool(x and y and x[1] == y[1] and x[2] != y[2])


def numbers_differ(a: str, b: str) -> bool:
    """FN18: different numbers, whatever their order and leading zeros."""
    numbers = lambda s: sorted(n.lstrip("0") or "0" for n in re.findall("[0-9]+", s))
    return a != b and numbers(a) != numbers(b)


def blocked_short(a: str, b: str, score: float) -> bool:
    """FN16: short labels need a high score, equal lengths and one edit at most."""
    return max(len(a), len(b)) < 12 and not (score >= 0.97 and len(a) == len(b) and edit_distance(a, b) <= 1)


def slice_boundaries(text: str, most: int) -> list[tuple[int, int]]:
    """FN43: byte ranges of at most `most` bytes, cut at a heading, blank line, line end or character."""
    data = text.encode("utf-8")
    size, out, start = max(most, 1), [], 0
    inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    while len(data) - start > size:
        hard = start + size
        while inside(hard) and hard > start:
            hard -= 1
        if hard == start:  # one character is longer than the limit
            hard += 1
            while inside(hard):
                hard += 1
        cuts = [at + after for mark, after in ((b"\n#", 1), (b"\n\n", 2), (b"\n", 1)) if (at := data.rfind(mark, start, hard)) >= 0]
        out.append((start, cuts[0] if cuts else hard))
        start = out[-1][1]
    return [*out, (start, len(data))] if start < len(data) or not data else out


def file_tokens(length: Column) -> Column:
    """FN44: tokens that a file of so many characters is taken to have."""
    return F.expr("0") + F.floor((F.least(length, F.lit(20000)) + 160) / 4)


def token_cost(tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> float:
    """FN60: the price of a call, prices being for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def decay(age_days: Column, half_life: float) -> Column:
    """FN36: half for each half-life; no age, or no half-life, is 1."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life), F.lit(1.0))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp, whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
