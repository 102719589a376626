"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with an elastic net (L1 and L2),
which leaves most of them zero; a temperature, fitted on training texts that gave no
weights, puts the winning probability on scale. N-grams of one to three letters,
word edges included, are hashed into a fixed number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.runtime import ship

UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter; 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and their counts; both empty for a text without letters."""
    x = _letters()[np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")]
    x = np.concatenate([[32], x, [32]]).astype(np.uint64)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = (x[:-1] * k1) ^ (x[1:] * k2)
    three = (two[:-1] * k2) ^ (x[2:] * k3)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    counts = np.bincount(np.concatenate([((h * k1) >> shift).astype(np.int64) for h in (x[x != 32], two * k3, three)]), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    def __init__(self, buckets: int = 1 << 16, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4):
        self.buckets, self.alpha, self.beta, self.l1, self.l2, self.epochs = buckets, alpha, beta, l1, l2, epochs
        self.languages: list[str] = []
        self.idf, self.weights, self.bias, self.temperature = np.ones(buckets), np.zeros((buckets, 0)), np.zeros(0), 1.0

    def _vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / max(np.linalg.norm(v), 1e-12)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, str, int]]) -> LanguageModel:
        """rows: (buckets, counts, language, hash); every fifth by hash fits the temperature only."""
        rows = sorted((r for r in rows if len(r[0])), key=lambda r: r[3])
        self.languages = sorted({r[2] for r in rows})
        if not rows:
            return self
        df = np.zeros(self.buckets)
        for at, *_ in rows:
            df[at] += 1
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        number = {lang: i for i, lang in enumerate(self.languages)}
        data = [(at, self._vector(at, counts), number[lang], h % 5 == 0) for at, counts, lang, h in rows]
        c = len(self.languages)
        z, n = np.zeros((self.buckets + 1, c)), np.zeros((self.buckets + 1, c))
        leader = lambda z, n: np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        for _ in range(self.epochs):
            for at, x, y, held in data:
                if held and len(data) >= 20:
                    continue
                at1, x1 = np.append(at, self.buckets), np.append(x, 1.0)
                w = leader(z[at1], n[at1])
                p = self._softmax(x1 @ w)
                p[y] -= 1
                g = x1[:, None] * p
                n0 = n[at1]
                z[at1] += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / self.alpha * w
                n[at1] = n0 + g * g
        w = leader(z, n)
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1]
        held = [(x @ self.weights[at] + self.bias, y) for at, x, y, h in data if h] or [(x @ self.weights[at] + self.bias, y) for at, x, y, _ in data]
        loss = lambda t: -sum(math.log(max(self._softmax(s / t)[y], 1e-12)) for s, y in held)
        a, b = -3.0, 3.0
        for _ in range(40):  # golden section over the logarithm of the temperature
            u, v = b - 0.618 * (b - a), a + 0.618 * (b - a)
            a, b = (a, v) if loss(math.exp(u)) < loss(math.exp(v)) else (u, b)
        self.temperature = math.exp((a + b) / 2)
        return self

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text, self.buckets)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = self._softmax((self._vector(at, counts) @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 400, **settings) -> LanguageModel:
    """A model from at most max_docs whole texts of each language, those with the smallest hashes of id and text.

    Repeated rows count once; rows with a null language or id give nothing. Features are
    computed on the executors; the driver gets at most the bucket counts of the sample.
    """
    ship(docs.sparkSession)
    model = LanguageModel(**settings)
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("l is not null and i is not null")
    counts = {r["l"]: r["n"] for r in src.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return model
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, math.ceil(min(1.0, 2 * max_docs / n) * (1 << 20)))])
    some = src.withColumn("h", F.xxhash64("i", "t", F.lit(11))).filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("l")]).dropDuplicates(["l", "h"])
    some = some.withColumn("n", F.row_number().over(W.partitionBy("l").orderBy("h"))).filter(F.col("n") <= max_docs).select("h", "l", "t")
    buckets = model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t, buckets) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32).tobytes() for x, _ in f], pa.binary()), pa.array([x.astype(np.int32).tobytes() for _, x in f], pa.binary())], names=["h", "l", "at", "n"])

    rows = some.mapInArrow(run, "h long, l string, at binary, n binary").toLocalIterator()
    return model.fit([(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.n, np.int32).astype(float), r.l, r.h & (1 << 63) - 1) for r in rows])


def prediction_of(spark, text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of each whole text as a column; rows stay in place, only texts pass through Python."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(t: pa.Array) -> pa.Array:
        got = [shared.value.predict(x) for x in t.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text.cast("string"))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text; other columns are not read.

    A null text or one without letters is ``und`` with score 0. The model has a fixed
    size and is broadcast; there is no shuffle. Repeated rows and null ids pass through;
    an empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), prediction_of(docs.sparkSession, F.col(text_col), model).alias("p"))
    return found.select("doc_id", "p.lang_pred", "p.score")
