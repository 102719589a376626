"""Pluggable batch scorers and candidate providers, with deterministic stand-ins for tests.

A real model is registered under a name as a pandas UDF over one or two text columns (or
a provider for mapInPandas); the stand-ins compute cheap scores from the text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

SCORERS: dict[str, Callable[..., Column]] = {}


def register(name: str):
    def add(f):
        SCORERS[name] = f
        return f

    return add


@register("style")
def style_probability(text: Column) -> Column:
    """Stand-in: share of exclamation and question marks, squashed."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[!?]", ""))
    return 1 / (1 + F.exp(1.0 - 2.0 * marks))


@register("content")
def content_overlap(text: Column, reference: Column) -> Column:
    """Stand-in: share of the text's tokens that the reference has."""
    return T.lexical_overlap(T.tokens(reference), T.tokens(text))


@register("embedding")
def embedding(text: Column, dims: int = 16) -> Column:
    """Stand-in: counts of hashed tokens."""
    t = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(t, lambda b: b == i)).cast("double"))


@register("perplexity")
def perplexity(text: Column) -> Column:
    """Stand-in: exp of the mean token length."""
    t = T.tokens(text)
    return F.exp(F.aggregate(t, F.lit(0.0), lambda s, w: s + F.length(w)) / F.greatest(F.size(t), F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def label_probability(label: Column, score: Column, positive: str) -> Column:
    """The positive label's probability from a (label, score) answer; the positive label is always named."""
    return F.when(F.lower(label) == positive.lower(), score).otherwise(1 - score)


def directed(p: Column, satirizing: Column) -> Column:
    return F.when(satirizing, p).otherwise(1 - p)


def softmax2(x0: Column, x1: Column) -> Column:
    """Probability of class 1 of two logits."""
    m = F.greatest(x0, x1)
    return F.exp(x1 - m) / (F.exp(x0 - m) + F.exp(x1 - m))


def score_all(df: DataFrame, text: str, reference: str, positive_style: bool = True) -> DataFrame:
    """Adds the four scores that reranking uses."""
    e, r = SCORERS["embedding"](F.col(text)), SCORERS["embedding"](F.col(reference))
    return df.withColumn("style", directed(SCORERS["style"](F.col(text)), F.lit(positive_style))).withColumn("similarity", F.coalesce(cosine(e, r), F.lit(0.0))).withColumn("perplexity", SCORERS["perplexity"](F.col(text))).withColumn("content", SCORERS["content"](F.col(text), F.col(reference)))


def candidates(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Stand-in provider: n variants of a text in order (as is, reversed words, doubled mark), empties dropped."""
    w = T.words(F.col(text))
    made = F.array(*[F.array_join(w, " "), F.array_join(F.reverse(w), " "), F.concat(F.array_join(w, " "), F.lit("!"))][:n])
    return df.withColumn("candidates", F.filter(F.array_distinct(made), lambda c: c != ""))


def dedupe_candidates(c: Column) -> Column:
    """Keep the first of candidates equal after normalisation; drop empty ones; [""] when none is left."""
    keyed = F.transform(c, lambda x, i: F.struct(T.normalize(x).alias("k"), i.alias("i"), x.alias("x")))
    # sorted by key and place, the first of each run of equal keys stays; texts are normalised once each
    runs = T.bound(F.array_sort(F.filter(keyed, lambda s: s["k"] != "")), lambda s: F.filter(s, lambda x, i: (i == 0) | (s[F.greatest(i - 1, F.lit(0))]["k"] != x["k"])))
    kept = F.transform(F.array_sort(F.transform(runs, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
    return T.bound(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit(""))).otherwise(k))


def first_distinct(c: Column, n: int) -> Column:
    """The first n different candidates, each at its first place."""
    return F.slice(F.array_distinct(c), 1, n)
