"""n-gram document and term frequencies, repetition penalties, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import Scratch

#: English function words for term counts.
STOP = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def document_frequency(df: DataFrame, text: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram, n): in how many rows each n-gram occurs. explode and a map-side combined count; no per-key set."""
    return df.select(F.explode(T.ngram_set(T.tokens(F.col(text)), sizes)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def overused(df: DataFrame, text: str, at_least: int = 75, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram, n) of the n-grams that occur in at_least rows or more."""
    return document_frequency(df, text, sizes).filter(F.col("n") >= at_least)


def hits(df: DataFrame, key: str, text: str, grams: DataFrame, sizes: tuple[int, ...] = (2, 3), few: int = 500_000) -> DataFrame:
    """(key, gram, n): the n-grams of each row that are among grams.

    An n-gram of nearly every row would be one key of a shuffle by n-gram, so as long as
    there are at most ``few`` grams they are broadcast and rows stay where they are.
    """
    grams = Scratch(df.sparkSession, "grams").table(grams, "counted")
    each = df.select(key, F.explode(T.ngram_set(T.tokens(F.col(text)), sizes)).alias("gram"))
    return each.join(F.broadcast(grams) if grams.count() <= few else grams, "gram")


def repetition(df: DataFrame, key: str, text: str, grams: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Adds repetition_penalty = sum of log1p(count) over a row's overused n-grams, and weight = 1/(1+penalty)."""
    found = hits(df, key, text, grams, sizes).groupBy(key).agg(F.sum(F.log1p(F.col("n").cast("double"))).alias("_p"))
    d = df.join(found, key, "left").withColumn("repetition_penalty", F.round(F.coalesce("_p", F.lit(0.0)), 6)).drop("_p")
    return d.withColumn("weight", F.round(1 / (1 + F.col("repetition_penalty")), 6))


def plain_terms(c: Column) -> Column:
    """Lower-cased words without punctuation and stop-words."""
    w = F.split(T.squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")), " ")
    return F.filter(w, lambda x: (x != "") & ~x.isin(STOP))


def term_frequency(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    return df.select(F.explode(T.ngrams(plain_terms(F.col(text)), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties in the grams' order (a top-k plan, no full sort)."""
    return counts.orderBy(F.desc("n"), "gram").limit(k)
