"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

Each class has a word bigram model with counts of its own. What discounting takes from a
class's counts is the weight of its backoff: from bigrams to the class's unigrams, and
from those to one distribution of continuation counts (how many different words a word
follows), gathered from both classes together. The discount of an expression is 0.75;
that of one whose share of documents does not differ between the classes beyond chance,
rare ones above all, is its whole count, so it is smoothed through the shared counts and
says next to nothing for a class. Both models sum to one in every context:

p(w|c) = (sum of kept counts of w + freed(c) * s(w)) / n(c)
p(w|h, c) = (kept count of hw + freed(h, c) * p(w|c)) / n(h, c)

A text's evidence is the difference of its length-normalised log-likelihoods under the
two models, over the whole text and over its most toxic window, put on a probability
scale by logistic calibration on evidence from models whose counts leave the text itself
out (four folds); the final counts take all training texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import Coder, words
from corpusmill.runtime import ship

CLASSES = (0, 1)


class Sample:
    """Coded training texts: how often each word and word pair occurs in each document."""

    def __init__(self, rows: Iterable[tuple[str | None, int]]):
        """rows: (text, 1 for toxic or 0). Copies count once, so none is in another fold than its original."""
        ids: dict[bytes, int] = {}
        self.coded, labels, seen = [], [], set()
        for text, label in rows:
            w, y = words(text), int(label)
            if (key := hash((y, tuple(w)))) in seen:
                continue
            seen.add(key)
            self.coded.append(np.array([ids.setdefault(x, len(ids)) for x in w], np.int32))
            labels.append(y)
        self.names, self.labels = list(ids), np.array(labels, int)
        self.size = max(len(ids), 1)
        doc = np.repeat(np.arange(len(self.coded), dtype=np.int32), [len(c) for c in self.coded])
        word = np.concatenate([np.zeros(0, np.int32), *self.coded])
        self.words = self._per_document(doc, word, self.size)
        follows = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
        self.pairs, pair = np.unique(word[:-1][follows] * np.int64(self.size) + word[1:][follows], return_inverse=True)
        self.pair_counts = self._per_document(doc[1:][follows], pair.astype(np.int32), max(len(self.pairs), 1))

    @staticmethod
    def _per_document(doc: np.ndarray, what: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, expression, times) of each expression that a document holds."""
        key, times = np.unique(doc * np.int64(size) + what, return_counts=True)
        return (key // size).astype(np.int32), (key % size).astype(np.int32), times.astype(np.int32)

    def counts(self, entries: tuple, size: int, take: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By class: occurrences of each expression, and documents that hold it, in the documents taken."""
        doc, what, times = entries
        by = [take[doc] & (self.labels[doc] == c) for c in CLASSES]
        return [np.bincount(what[m], times[m], size) for m in by], [np.bincount(what[m], minlength=size) for m in by]


class KneserNey:
    """The two models over the documents taken of a sample."""

    def __init__(self, sample: Sample, take: np.ndarray, discount: float, z: float):
        self.sample, v = sample, sample.size
        docs = [int((take & (sample.labels == c)).sum()) for c in CLASSES]
        uni, df = sample.counts(sample.words, v, take)
        bi, df2 = sample.counts(sample.pair_counts, len(sample.pairs), take) if len(sample.pairs) else ([np.zeros(0)] * 2, [np.zeros(0)] * 2)
        self.telling, self.telling_pairs = self._telling(df, docs, z), self._telling(df2, docs, z)
        left, right = sample.pairs // v, sample.pairs % v
        present = bi[0] + bi[1] > 0
        self.follows = np.bincount(right[present], minlength=v)
        self.contexts = int(present.sum())
        kept = [np.where(self.telling, np.maximum(uni[c] - discount, 0), 0) for c in CLASSES]
        self.total = [float(uni[c].sum()) for c in CLASSES]
        self.kept = kept
        self.freed = [1 - kept[c].sum() / self.total[c] if self.total[c] else 1.0 for c in CLASSES]
        kept2 = [np.where(self.telling_pairs, np.maximum(bi[c] - discount, 0), 0) for c in CLASSES]
        self.context = [np.bincount(left, bi[c], v) for c in CLASSES]
        self.kept2 = kept2
        self.freed2 = [1 - np.bincount(left, kept2[c], v) / np.maximum(self.context[c], 1) for c in CLASSES]

    @staticmethod
    def _telling(df: list[np.ndarray], docs: list[int], z: float) -> np.ndarray:
        """Where the share of documents differs between the classes by z standard errors or more."""
        if not all(docs):
            return np.zeros(len(df[0]), bool)
        p = (df[0] + df[1]) / sum(docs)
        error = np.sqrt(p * np.maximum(1 - p, 1e-9) * (1 / docs[0] + 1 / docs[1]))
        return (np.abs(df[1] / docs[1] - df[0] / docs[0]) >= z * error) & (df[0] + df[1] >= 4)

    def shared(self, w: np.ndarray) -> np.ndarray:
        """Continuation probability of word numbers, alike for both classes; -1 is any word that was not seen."""
        seen = np.where(w >= 0, self.follows[w], 0)
        return (seen + 1) / (self.contexts + len(self.sample.names) + 1)

    def unigram(self, c: int, w: np.ndarray) -> np.ndarray:
        own = np.where(w >= 0, self.kept[c][w], 0) / self.total[c] if self.total[c] else 0.0
        return own + self.freed[c] * self.shared(w)

    def bigram(self, c: int, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w|h, c); h of -1 is no word or one that was not seen."""
        key, pairs = h * np.int64(self.sample.size) + w, self.sample.pairs
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        hit = (pairs[at] == key) & (h >= 0) & (w >= 0) if len(pairs) else np.zeros(len(h), bool)
        n = np.where(h >= 0, self.context[c][h], 0)
        own = np.where(hit, self.kept2[c][at] if len(pairs) else 0, 0) / np.maximum(n, 1)
        return own + np.where(n > 0, self.freed2[c][h], 1.0) * self.unigram(c, w)

    def log_likelihood(self, c: int, code: np.ndarray) -> np.ndarray:
        """Log probability of each word of a coded text."""
        if not len(code):
            return np.zeros(0)
        return np.log(self.bigram(c, np.concatenate([[-1], code[:-1]]).astype(np.int64), code.astype(np.int64)))


class ToxicityModel:
    """Differences of the two models' log probabilities, laid out for scoring, and the calibration.

    Where neither a word nor its context is telling the difference is one constant, so only
    what departs from it is kept.
    """

    FOLDS = 4

    def __init__(self, window: int = 64, discount: float = 0.75, z: float = 4.0):
        self.window, self.discount, self.z = window, discount, z
        self.coder, self.uni, self.after = Coder({}), np.zeros(1), np.zeros(1)
        self.pairs, self.bi = np.zeros(0, np.int64), np.zeros(0)
        self.weights = np.array([-3.0, 0.0, 0.0])

    def fit(self, rows: Iterable[tuple[str | None, int]], base_rate: float) -> ToxicityModel:
        sample = Sample(rows)
        fold = np.arange(len(sample.coded)) % self.FOLDS
        x = np.zeros((len(sample.coded), 2))
        for k in range(self.FOLDS):
            number = self._lay_out(KneserNey(sample, fold != k, self.discount, self.z))
            for i in np.flatnonzero(fold == k):
                x[i] = self._evidence(number[sample.coded[i]])
        self._lay_out(KneserNey(sample, fold >= 0, self.discount, self.z))
        self._calibrate(x, sample.labels, base_rate)
        return self

    def _lay_out(self, m: KneserNey) -> np.ndarray:
        """Sets the differences; returns the coder's number of each word of the sample (0: none)."""
        v = m.sample.size
        ends = m.sample.pairs[m.telling_pairs]
        h, w = ends // v, ends % v
        used = np.unique(np.concatenate([np.flatnonzero(m.telling), h, w]))
        code = np.zeros(v, np.int64)
        code[used] = np.arange(1, len(used) + 1)
        self.coder = Coder({m.sample.names[k]: i + 1 for i, k in enumerate(used.tolist())})
        every = np.concatenate([[-1], used]).astype(np.int64)
        self.uni = np.log(m.unigram(1, every)) - np.log(m.unigram(0, every))
        back = [np.concatenate([[1.0], np.where(m.context[c][used] > 0, m.freed2[c][used], 1.0)]) for c in CLASSES]
        self.after = np.log(back[1]) - np.log(back[0])
        self.pairs = code[h] * len(every) + code[w]
        order = np.argsort(self.pairs)
        self.pairs = self.pairs[order]
        self.bi = (np.log(m.bigram(1, h, w)) - np.log(m.bigram(0, h, w)))[order]
        return code

    def differences(self, code: np.ndarray) -> np.ndarray:
        """Log probability under the toxic model less that under the other, of each word."""
        r = self.uni[code]
        if len(code) > 1:
            r[1:] += self.after[code[:-1]]
            if len(self.pairs):
                at = np.flatnonzero((code[:-1] > 0) & (code[1:] > 0))
                key = code[at] * len(self.uni) + code[at + 1]
                k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                hit = self.pairs[k] == key
                r[at[hit] + 1] = self.bi[k[hit]]
        return r

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Mean difference over the whole text (without words: that of an unknown one), and over its most toxic window."""
        return self._evidence(self.coder.codes(text))

    def _evidence(self, code: np.ndarray) -> tuple[float, float]:
        n = len(code)
        if not n:
            return float(self.uni[0]), 0.0
        r = self.differences(code)
        mean = float(r.mean())
        if n <= self.window:
            return mean, float(r.sum()) / self.window
        s = np.concatenate([[0.0], np.cumsum(r)])
        return mean, float((s[self.window :] - s[: -self.window]).max()) / self.window

    @staticmethod
    def _inputs(mean: float, window: float) -> tuple[float, float, float]:
        return 1.0, min(max(100 * mean, -10.0), 20.0), min(max(20 * window, -10.0), 20.0)

    def _calibrate(self, evidence: np.ndarray, labels: np.ndarray, base_rate: float) -> None:
        if len(set(labels.tolist())) < 2:
            return
        x = np.array([self._inputs(*e) for e in evidence])
        y = labels.astype(float)
        base_rate = min(max(base_rate, 1e-4), 1 - 1e-4)
        weight = np.where(y == 1, base_rate / y.mean(), (1 - base_rate) / (1 - y.mean()))
        b, ridge = np.array([math.log(base_rate / (1 - base_rate)), 0.0, 0.0]), np.diag([1e-3, 1e-1, 1e-1])
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (y - q)) - ridge @ b)
            b = b + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = b

    def score(self, text: str | None) -> float:
        z = float(self.weights @ self._inputs(*self.evidence(text)))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 2000, **settings) -> ToxicityModel:
    """A model from the labelled documents, at most max_docs of each class.

    Those with the smallest hashes of their ids are taken, so the sample is the same on
    every run; its whole texts pass through the driver one by one and only counts stay.
    An id that is labelled more than once is toxic if any label says so; one with several
    texts gives the text with the smallest hash. Null labels and labels without a document
    are left out; one class alone gives a model that scores every text low.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.col("_id"), F.lit(7))
    chosen = None
    for y, n in sorted(counts.items()):
        share = math.ceil(min(1.0, 2 * max_docs / n) * (1 << 20))
        some = known.filter((F.col("_y") == y) & (F.pmod(h, F.lit(1 << 20)) < share)).orderBy(h, "_id").limit(max_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return ToxicityModel(**settings).fit([], 0.0)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(chosen), "_id")
    rows = texts.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t"))).alias("s"))
    return ToxicityModel(**settings).fit(((r["t"], r["_y"]) for r in rows.orderBy(h).select(F.col("s.t").alias("t"), "_y").toLocalIterator()), counts.get(1, 0) / sum(counts.values()))


def score_of(spark, text: Column, model: ToxicityModel) -> Column:
    """The score of each whole text as a column; rows stay in place, only texts pass through Python."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(t: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x) for x in t.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every whole text; other columns are not read.

    The model (bounded by its training sample) is broadcast; rows are independent, so
    there is no shuffle. Null and empty texts get the score of no evidence; repeated
    rows and null ids pass through; an empty table gives an empty result.
    """
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(docs.sparkSession, F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
