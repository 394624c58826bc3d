"""Name similarity: sorted tokens, longest common subsequence, fuzzy query match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from shelfspark.functions.text import col, let, match_all_tokens, squash_title

# Words left out of a product name before matching.
FILLER_WORDS = ["fresh", "pure", "best", "quality", "original", "new", "premium", "special",
                "super", "extra", "deluxe", "imported", "local"]

WORD, LCS_ROWS = 64, 4_096  # bits of a word; pairs whose words are laid out together


def normalize_name(title: Column | str, value: Column | str, unit: Column | str) -> Column:
    """Lower-case title without filler words, followed by its size in g or ml."""
    value, unit = col(value), F.lower(col(unit))
    fillers = r"\b(" + "|".join(FILLER_WORDS) + r")\b"
    words = squash_title(F.regexp_replace(
        F.lower(F.coalesce(col(title), F.lit(""))), fillers, ""))
    whole = F.when(unit.isin("kg", "l"), value * 1000).otherwise(value).cast("long").cast("string")
    size = (
        F.when(unit.isin("kg", "g"), F.concat(F.lit(" "), whole, F.lit("g")))
        .when(unit.isin("l", "ml"), F.concat(F.lit(" "), whole, F.lit("ml")))
        .when((unit != "") & value.isNotNull(), F.concat(F.lit(" "), value.cast("string"), unit))
    )
    return F.concat(words, F.coalesce(size, F.lit("")))


def sorted_tokens(name: Column | str) -> Column:
    tokens = F.filter(F.split(col(name), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(tokens), " ")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & places.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio over the shared words and the words only one side has."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, only_a, only_b = left & right, left - right, right - left
    if shared and (not only_a or not only_b):
        return 100.0
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    base = len(" ".join(sorted(shared)))
    gap = 1 if base else 0
    full_a, full_b = base + gap + len(rest_a), base + gap + len(rest_b)
    distance = len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b)
    best = 100.0 - 100.0 * distance / (full_a + full_b)
    if base:
        for rest, whole in ((rest_a, full_a), (rest_b, full_b)):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (base + whole))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    best = 0.0
    for start in range(1 - n, len(b)):
        best = max(best, ratio(a, b[max(start, 0):start + n]))
        if best == 100.0:
            return best
    if len(b) == n:
        for start in range(1 - n, n):
            best = max(best, ratio(b, a[max(start, 0):start + n]))
    return best


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the length of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.fromiter(map(len, texts), np.int64, len(texts))


def _laid_out(codes: np.ndarray, sizes: np.ndarray, filler: int) -> np.ndarray:
    """Row i holds character i of every text, ``filler`` behind its end."""
    out = np.full((sizes.max(initial=0), len(sizes)), filler)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), text] = codes
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of each pair; a text of ``a`` has at most 64 characters, a bit each of one word."""
    (points_a, sizes_a), (points_b, sizes_b) = _characters(a), _characters(b)
    seen = np.zeros(int(max(points_a.max(initial=0), points_b.max(initial=0))) + 1, bool)
    seen[points_a] = True
    width = int(seen.sum()) + 1  # the last place stands for all other characters
    number = np.where(seen, np.cumsum(seen) - 1, width - 1)
    first = np.arange(len(a)) * width
    places = np.zeros(len(a) * width, np.uint64)
    for i, codes in enumerate(_laid_out(number[points_a], sizes_a, width - 1)):
        places[first + codes] |= np.uint64(1 << i)
    places[width - 1::width] = 0
    rows = np.full(len(a), ~np.uint64(0))
    for codes in _laid_out(number[points_b], sizes_b, width - 1):
        hit = rows & places[first + codes]
        rows = (rows + hit) | (rows - hit)
    # Carries only go up, so the bits above a text's length never reach those below.
    unused = np.where(sizes_a > 0, ~np.uint64(0) >> (64 - np.maximum(sizes_a, 1)).astype(np.uint64), np.uint64(0))
    return sizes_a - np.bitwise_count(rows & unused)


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int64)
    short = np.array([min(len(x), len(y)) <= WORD for x, y in zip(a, b)], bool)
    for at in range(0, len(a), LCS_ROWS):
        part = at + np.flatnonzero(short[at:at + LCS_ROWS])
        pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a.iloc[part], b.iloc[part])]
        if pairs:
            out[part] = lcs_lengths(*map(list, zip(*pairs)))
    for i in np.flatnonzero(~short):
        out[i] = lcs_length(a.iloc[i], b.iloc[i])
    return pd.Series(out, dtype="int32")


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """200 times the common subsequence of the sorted tokens over both lengths."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(lcs(a, b) * F.lit(200.0) / total)


#: White space as ``str.split`` has it.
BREAKS = "(?U)[\\s\\x1c-\\x1f]+"


def _joined_length(words: Column) -> Column:
    """Length of the words joined by one space."""
    total = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return total + F.greatest(F.size(words) - 1, F.lit(0))


def may_reach_token_set(title: Column, query: str, threshold: float) -> Column:
    """False only where ``token_set_ratio`` with the query is surely below the threshold.

    The branches over shared words are exact. The distance of the words that only one side has is at
    least what their bags of characters differ by.
    """
    known = F.array(*[F.lit(w) for w in sorted(set(query.split()))])
    words = F.array_distinct(F.filter(F.split(title, BREAKS), lambda w: w != ""))
    parts = F.struct(F.size(words).alias("n"), F.array_intersect(words, known).alias("both"),
                     F.array_except(words, known).alias("a"), F.array_except(known, words).alias("b"))

    def bound(p: Column) -> Column:
        base, rest_a, rest_b = (_joined_length(p[c]) for c in ("both", "a", "b"))
        gap = (base > 0).cast("int")
        total = 2 * (base + gap) + rest_a + rest_b
        text_a, text_b = F.array_join(p["a"], " "), F.array_join(p["b"], " ")
        common = F.lit(0)
        for ch in sorted(set(query)):
            common = common + F.least(*[F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
                                        for t in (text_a, text_b)])
        most = F.lit(threshold - 1e-9)
        by_length = 100.0 - 100.0 * F.abs(rest_a - rest_b) / total
        by_bag = 100.0 - 100.0 * (rest_a + rest_b - 2 * common) / total
        one_side = [100.0 - 100.0 * (gap + r) / (2 * base + gap + r) for r in (rest_a, rest_b)]
        subset = (F.size(p["both"]) > 0) & ((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0))
        return (p["n"] > 0) & (subset | ((base > 0) & (F.greatest(*one_side) >= most))
                               | ((by_length >= most) & (by_bag >= most)))
    return F.when(F.lit(bool(query.split())), F.coalesce(let(parts, bound), F.lit(False))).otherwise(False)


def _pieces(word: str, n: int) -> list[str]:
    cuts = [len(word) * i // n for i in range(n + 1)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def may_reach_partial(title: Column, word: str, threshold: float) -> Column:
    """False only where ``partial_ratio`` of the word is surely below the threshold.

    Inside the title a stretch is as long as the word, so both miss equally many characters; at its ends
    stretches are shorter. Of one piece more than there may be differences, one stands there unchanged.
    Titles no longer than the word swap roles and are not judged.
    """
    n, loose = len(word), (100.0 - threshold) / 100.0
    inside, ends = 2 * int(n * loose + 1e-9) + 1, int(2 * n * loose + 1e-9) + 1
    if max(inside, ends) > n:
        return F.lit(True)
    found = F.length(title) <= n
    for piece in _pieces(word, inside):
        found = found | F.contains(title, F.lit(piece))
    edge = F.concat(F.substring(title, 1, n - 1), F.lit("\0"), F.substring(title, 1 - n, n - 1)) if n > 1 else None
    for piece in _pieces(word, ends) if n > 1 else ():
        found = found | F.contains(edge, F.lit(piece))
    return found


def match_fuzzy(title: Column | str, query: str, token_threshold: float = 90,
                fuzzy_threshold: float = 80) -> Column:
    """All query words present, or alike as a whole, or one word nearly present.

    A title that holds a query word as it stands is alike. Only titles that fail these tests and may still
    be alike by a native bound reach the Python step.
    """
    title = col(title)
    words = query.split()
    sure = match_all_tokens(title, query)
    if token_threshold <= 100:
        for word in words:
            sure = sure | F.coalesce(F.contains(title, F.lit(word)), F.lit(False))

    @F.pandas_udf(BooleanType())
    def alike(titles: pd.Series) -> pd.Series:
        def one(text) -> bool:
            if not isinstance(text, str):
                return False
            return token_set_ratio(text, query) >= fuzzy_threshold or any(
                partial_ratio(w, text) >= token_threshold for w in words)
        return titles.map(one).astype(bool)

    may = may_match(title, query, token_threshold, fuzzy_threshold)
    return sure | alike(F.when(~sure & may, title))


def may_match(title: Column, query: str, token_threshold: float = 90, fuzzy_threshold: float = 80) -> Column:
    """The titles that a fuzzy match cannot rule out without comparing them."""
    may = may_reach_token_set(title, query, fuzzy_threshold)
    for word in query.split():
        may = may | may_reach_partial(title, word, token_threshold)
    return may
