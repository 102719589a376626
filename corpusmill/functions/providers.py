"""Candidate providers: batches of texts to lists of candidates, with retries and dead letters.

A provider is any picklable callable of a list of texts that returns one list of
candidates for each. It runs in mapInPandas, so calls are spread over the executors, and
a batch that fails for good becomes rows with an error instead of candidates.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import jsonrepair, scorers
from corpusmill.operators import rerank, selection
from corpusmill.runtime import ship

Provider = Callable[[list[str]], list[list[str]]]


def kind_of(error: Exception) -> str:
    """rate, unavailable or other, by what an error says; as jsonrepair.error_class."""
    m = str(error)
    return "rate" if "429" in m else "unavailable" if "503" in m or "UNAVAILABLE" in m else "other"


def wait_for(error: Exception, attempt: int) -> int:
    """Seconds before the next try: what a rate limit asks for plus 5 (65 if it names none), else a growing wait."""
    kind = kind_of(error)
    if kind == "rate":
        found = re.search(jsonrepair.RETRY, str(error))
        return int(found[1]) + 5 if found else 65
    return min(15 * attempt, 120) if kind == "unavailable" else 5 * attempt


def call(provider: Provider, texts: list[str], tries: int = 3, sleep: Callable[[float], None] = time.sleep, patience: int | None = None) -> tuple[list[list[str]], str | None]:
    """(candidates, None), or (empty lists, the last error).

    Rate limits and outages are waited for, without end unless ``patience`` bounds them;
    any other failure, a reply of the wrong length among them, is tried ``tries`` times.
    """
    failures = waits = 0
    while True:
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return got, None
        except Exception as e:
            if kind_of(e) == "other":
                failures += 1
                if failures >= tries:
                    return [[] for _ in texts], f"{type(e).__name__}: {e}"[:500]
                sleep(wait_for(e, failures))
            else:
                waits += 1
                if patience is not None and waits > patience:
                    return [[] for _ in texts], f"{type(e).__name__}: {e}"[:500]
                sleep(wait_for(e, waits))


def generate(df: DataFrame, text: str, provider: Provider, batch: int = 6, tries: int = 3, sleep: Callable[[float], None] = time.sleep, patience: int | None = 10) -> DataFrame:
    """Adds candidates (array of strings) and error (null where the provider answered).

    Texts go to the provider in batches of ``batch``, the last one of a partition's batch
    partial; null texts are sent as empty. A batch that fails for good keeps its rows, with
    no candidates and the error, so nothing is dropped unseen.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corpusmill.functions.providers import call

        for frame in frames:
            found, errors = [], []
            texts = [t if isinstance(t, str) else "" for t in frame[text].tolist()]
            for at in range(0, len(texts), batch):
                got, error = call(provider, texts[at : at + batch], tries, sleep, patience)
                found += got
                errors += [error] * len(got)
            yield frame.assign(candidates=found, error=errors)

    return df.mapInPandas(run, schema)


def pick_and_emit(df: DataFrame, key: str, text: str, provider: Provider, weights: rerank.Weights = rerank.Weights(), **settings) -> tuple[DataFrame, DataFrame]:
    """(key, text, candidate, position, scores, score) of the best candidate of each row, and the rows that got none.

    Candidates are de-duplicated, scored by the registered scorers and combined linearly;
    ties go to the first. A null text is taken as empty.
    """
    made = generate(df.select(key, F.coalesce(text, F.lit("")).alias(text)), text, provider, **settings)
    each = made.filter(F.col("error").isNull()).select(key, text, F.posexplode(scorers.dedupe_candidates(F.col("candidates"))).alias("position", "candidate")).filter("candidate <> ''")
    scored = scorers.score_all(each, "candidate", text).withColumnRenamed("content", "copy")
    scored = scored.withColumn("score", F.round(rerank.linear_score(F.col("style"), F.col("similarity"), F.col("copy"), F.col("perplexity"), weights), 6))
    return selection.argmax(scored, [key], "score", "position"), made.filter((F.col("error").isNotNull()) | (F.size("candidates") == 0)).select(key, text, "error")
