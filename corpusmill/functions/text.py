"""Text column functions: normalisation, tokens, n-grams, copy metrics."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: White space as Unicode and Python see it; Java's own class misses part of it.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"

#: The character folding that results must agree with.
FOLD_FROM = "–—‘’“”éèêàâôûçñüäö"
FOLD_TO = "--''\"\"eeeaaoucnuao"
FOLD_LONG = {"…": "...", "ß": "ss"}
_TOKENS = re.compile("[a-z']+")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Strip and make every run of white space one space; case is kept."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def normalize(c: Column) -> Column:
    return squeeze(F.lower(c))


def tokens(c: Column) -> Column:
    """Runs of a-z and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def words(c: Column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def ngrams(t: Column, n: int) -> Column:
    """Space-joined n-grams of an array, in order, repeats included.

    The shifted arrays are zipped, so the tokens are computed n times for a row; a slice
    inside a lambda would compute them again for every n-gram.
    """
    if n == 1:
        return t
    shifted = F.arrays_zip(t, *[F.slice(t, k + 1, 1 << 30) for k in range(1, n)])
    return F.transform(F.slice(shifted, 1, F.greatest(F.size(t) - n + 1, F.lit(0))), lambda s: F.concat_ws(" ", *[s.getField(str(k)) for k in range(n)]))


def ngram_set(t: Column, sizes: tuple[int, ...]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[ngrams(t, n) for n in sizes])))


def opening_template(t: Column) -> Column:
    return F.when(F.size(t) < 2, "").otherwise(F.array_join(F.slice(t, 1, 2), " "))


def max_repeat_fraction(t: Column) -> Column:
    """Largest multiplicity of a token over the number of tokens, by one sort of the array."""
    s = F.array_sort(t)
    run = F.aggregate(s, F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")), lambda a, w: F.struct(w.alias("w"), F.when(a["w"] == w, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["m"], F.when(a["w"] == w, a["n"] + 1).otherwise(1)).alias("m")))
    return F.when(F.size(t) == 0, 0.0).otherwise(run["m"] / F.size(t))


def bound(value: Column, f) -> Column:
    """f(value) with value computed once for a row, however often f uses it inside lambdas."""
    return F.transform(F.array(value), f)[0]


@F.pandas_udf(DoubleType())
def lexical_overlap(src: pd.Series, cand: pd.Series) -> pd.Series:
    """Share of candidate tokens, with multiplicity, that the source has; 0 if either side has none. Linear in both."""
    return pd.Series([None if s is None or c is None else _share(s, c) for s, c in zip(src, cand)], dtype="float64")


def _share(source, candidate) -> float:
    if not len(source) or not len(candidate):
        return 0.0
    have = set(source)
    return sum(t in have for t in candidate) / len(candidate)


def longest_shared_ratio(src: Column, cand: Column, max_n: int = 4) -> Column:
    """Longest shared n-gram (2 to max_n) over the shorter side's length, capped at max_n; 0 below two tokens."""
    short = F.least(F.size(src), F.size(cand), F.lit(max_n))
    best = F.lit(0)
    for n in range(2, max_n + 1):
        best = F.when((short >= n) & F.arrays_overlap(ngrams(src, n), ngrams(cand, n)), n).otherwise(best)
    return F.when(short < 2, 0.0).otherwise(best / F.greatest(short, F.lit(1)))


def exact_copy(a: Column, b: Column) -> Column:
    return (normalize(a) == normalize(b)).cast("double")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two normalised texts; null with a null side."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _ratio(x: str, y: str) -> float:
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


_COPY_PARTS = ("exact_copy", "sequence_similarity", "lexical_overlap", "shared_ngram_ratio", "copy_penalty")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in _COPY_PARTS]))
def _copy_parts(src: pd.Series, cand: pd.Series) -> pd.DataFrame:
    """The four metrics and their weighted sum of normalised texts, each split into tokens once."""
    rows = []
    for x, y in zip(src, cand):
        if x is None or y is None:
            rows.append([None] * 5)
            continue
        s, c = _TOKENS.findall(x), _TOKENS.findall(y)
        short, best = min(len(s), len(c), 4), 0
        for n in range(short, 1, -1):
            grams = lambda t: zip(*(t[k:] for k in range(n)))  # noqa: B023, E731
            if not set(grams(s)).isdisjoint(grams(c)):
                best = n
                break
        e, q, lex, shared = float(x == y), _ratio(x, y), _share(s, c), best / short if short > 1 else 0.0
        rows.append([e, q, lex, shared, 1.5 * e + 0.5 * q + 0.3 * lex + 0.2 * shared])
    return pd.DataFrame(rows, columns=list(_COPY_PARTS), dtype="float64")


def copy_parts(src: Column, cand: Column) -> Column:
    """Struct of the four copy metrics and their weighted sum; null metrics with a null side."""
    return _copy_parts(normalize(src), normalize(cand))


def fold_ascii(c: Column) -> Column:
    out = F.translate(c, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_LONG.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_strings(df):
    """fold_ascii on every string column."""
    return df.select([fold_ascii(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def stem(w: str) -> str:
    """The Porter stem of a lower-case word."""
    v = "aeiou"

    def cons(s, i):
        return s[i] not in v and not (s[i] == "y" and i and cons(s, i - 1))

    def measure(s):
        k = "".join("c" if cons(s, i) else "v" for i in range(len(s)))
        return sum(k[i : i + 2] == "vc" for i in range(len(k)))

    def has_vowel(s):
        return any(not cons(s, i) for i in range(len(s)))

    def double(s):
        return len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)

    def cvc(s):
        return len(s) > 2 and cons(s, len(s) - 3) and not cons(s, len(s) - 2) and cons(s, len(s) - 1) and s[-1] not in "wxy"

    if len(w) < 3:
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and has_vowel(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    two = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
    three = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
    for table in (two, three):
        for a in sorted(table, key=len, reverse=True):
            if w.endswith(a):
                if measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + table[a]
                break
    for a in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(a):
            if measure(w[: -len(a)]) > 1 and (a != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(a)]
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("rouge1", "rouge2", "rougeL")]))
def rouge(target: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """ROUGE-1, -2 and -L F-measures over stemmed tokens."""
    import re
    from collections import Counter

    memo: dict[str, str] = {}

    def toks(x):
        out = []
        for w in re.findall("[a-z0-9]+", (x or "").lower()):
            if w not in memo:
                memo[w] = stem(w) if len(w) > 3 else w
            out.append(memo[w])
        return out

    def f(hit, p, t):
        return 2 * hit / (p + t) if hit else 0.0

    def lcs(a, b):
        # bit-parallel: one big integer holds a row of the table
        where: dict[str, int] = {}
        for i, w in enumerate(b):
            where[w] = where.get(w, 0) | 1 << i
        row, full = 0, (1 << len(b)) - 1
        for w in a:
            x = where.get(w, 0) | row
            row = x & ~(x - (row << 1 | 1)) & full
        return row.bit_count()

    rows = []
    for t, p in zip(target, prediction):
        a, b = toks(t), toks(p)
        grams = [[Counter(zip(*(x[k:] for k in range(n)))) for x in (a, b)] for n in (1, 2)]
        rows.append([*(f(sum((g & h).values()), sum(g.values()), sum(h.values())) for g, h in grams), f(lcs(a, b), len(a), len(b))])
    return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])
