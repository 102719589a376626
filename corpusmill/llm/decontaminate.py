"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first pass counts, over all documents, in how many each benchmark n-gram occurs.
An item's seeds are its n-grams that are not much commoner than its own median one, so
an item that leaked often keeps its seeds while stock phrases lose theirs. A second
pass aligns an item with the stretch of a document around its seeds; the score is the
local alignment's (match 2, mismatch and gap -1) over that of the item with itself, so
edits cost in proportion. Documents never move: both passes are maps, and only n-gram
counts and matches leave the executors.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import Coder, words
from corpusmill.runtime import ship

MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two number sequences, and where in passage it ends (exclusive).

    Row by row; a run of gaps within a row is a running maximum.
    """
    n = len(passage)
    best, end, row, steps = 0, 0, np.zeros(n + 1, np.int64), np.arange(n + 1) * -GAP
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
        row = np.maximum.accumulate(new + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(code: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit number for each run of size words; 0 for a run with a word that no item has."""
    code = code.astype(np.uint64)
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, size, np.uint64), np.ones(n, bool)
    for k in range(size):
        h = (h ^ code[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
        known &= code[k : k + n] > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


class Items:
    """A block of benchmark items, their n-grams and, after counting, their seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        """rows: (id, text); rows that share an id, or have none, are items of their own."""
        ids: dict[bytes, int] = {}
        self.names = [i for i, _ in rows]
        self.code = [np.array([ids.setdefault(x, len(ids) + 1) for x in words(t)], np.int32) for _, t in rows]
        self.coder = Coder(ids)
        by_size: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, c in enumerate(self.code):
            if len(c):
                by_size[min(n, len(c))].append((_hashes(c, min(n, len(c))), k))
        self.tables = []  # size, sorted n-grams, where each one's places start, items and positions of the places
        for size, found in sorted(by_size.items()):
            h = np.concatenate([x for x, _ in found])
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            item = np.repeat(np.array([k for _, k in found], np.int32), [len(x) for x, _ in found])[order]
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in found])[order]
            self.tables.append((size, keys, np.append(first, len(h)), item, place))
        self.df = [np.zeros(len(t[1]), np.int64) for t in self.tables]
        self.seed = [np.ones(len(t[1]), bool) for t in self.tables]

    def found(self, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, word positions, n-gram numbers) of the benchmark n-grams in a document."""
        for t, (size, keys, *_) in enumerate(self.tables):
            h = _hashes(code, size)
            at = np.flatnonzero(h)
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[k] == h[at]
            if hit.any():
                yield t, at[hit], k[hit]

    def choose(self, common: float, spread: float = 4.0) -> None:
        """Keep an item's n-grams found in at most the larger of common and spread times its median."""
        if not self.tables:
            return
        times = [np.repeat(df, np.diff(first)) for (_, _, first, _, _), df in zip(self.tables, self.df)]
        item, n = np.concatenate([t[3] for t in self.tables]), np.concatenate(times)
        order = np.lexsort((n, item))
        who, start, size = np.unique(item[order], return_index=True, return_counts=True)
        median = (n[order][start + (size - 1) // 2] + n[order][start + size // 2]) / 2
        limit = np.full(len(self.code), float(common))
        limit[who] = np.maximum(common, spread * median)
        self.seed = [np.logical_or.reduceat(n <= limit[t[3]], t[2][:-1]) for t, n in zip(self.tables, times)]

    def matches(self, text: str | None, threshold: float) -> list[tuple[int | None, float, int, int]]:
        """(item id, score, matched words from, to) of the items that align with the text, the best of each id."""
        best: dict = {}
        for k, *found in self._aligned(text, threshold):
            i = self.names[k]
            if i not in best or found[0] > best[i][0]:
                best[i] = found
        return [(i, *found) for i, found in best.items()]

    def _aligned(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        w = self.coder.codes(text)
        starts = defaultdict(set)  # where an item would begin, by item
        for t, at, k in self.found(w):
            ok = self.seed[t][k]
            _, _, first, items, place = self.tables[t]
            for p, g in zip(at[ok].tolist(), k[ok].tolist()):
                places = slice(first[g], first[g + 1])
                for i, q in zip(items[places].tolist(), place[places].tolist()):
                    starts[i].add(p - q)
        out = []
        for i, begin in starts.items():
            item = self.code[i]
            slack, best, need = len(item) // 2 + 2, (0.0, 0, 0), threshold * MATCH * len(item)
            lo = hi = None
            for b in [*sorted(begin), None]:  # overlapping stretches are aligned together
                if b is not None and hi is not None and b - slack <= hi:
                    hi = max(hi, b + len(item) + slack)
                    continue
                if hi is not None:
                    a, z = max(0, lo), min(len(w), hi)
                    if MATCH * int(np.isin(w[a:z], item).sum()) >= need:
                        s, end = align(item, w[a:z])
                        if s > best[0]:
                            best = (s, max(a, a + end - len(item)), a + end)
                if b is not None:
                    lo, hi = b - slack, b + len(item) + slack
            if best[0] >= need:
                out.append((i, best[0] / (MATCH * len(item)), best[1], best[2]))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, threshold: float = 0.5, common_share: float = 1e-4, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, score, word_from, word_to): every document and item that align at threshold or better.

    The benchmark is the stated query set: it is taken in blocks of at most block_bytes
    of text, each broadcast on its own, so a benchmark of any size needs bounded memory.
    An n-gram in at most common_share of all documents is always a seed. Items shorter
    than n words are one seed as a whole; null or empty texts match nothing; repeated
    documents give repeated matches; items that share an id are one item with several
    texts, of which the best counts (in each block); documents and items with a null id
    keep it; an empty table on either side gives an empty result; other columns are not
    read.
    """
    schema = "doc_id long, item_id long, score double, word_from long, word_to long"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for chosen in seeds(docs, benchmark, text_col, item_col, item_text, n, common_share, block_bytes):

        def match(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in chosen.value.matches(t, threshold)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "word_from", "word_to"])

        part = src.mapInArrow(match, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def holds_item(text: Column, chosen: list, threshold: float = 0.5) -> Column:
    """True where a whole text aligns with any item of the blocks that seeds() gives; rows stay in place."""
    def holds(block) -> Column:
        def run(t: pa.Array) -> pa.Array:
            return pa.array([bool(block.value.matches(x, threshold)) for x in t.to_pylist()], pa.bool_())

        return F.arrow_udf(run, "boolean")(text.cast("string"))

    return reduce(or_, map(holds, chosen), F.lit(False))


def seeds(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, common_share: float = 1e-4, block_bytes: int = 8 << 20) -> list:
    """Broadcast blocks of benchmark items with the seeds that the documents' n-gram counts leave them."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(text_col).cast("string").alias("t"))
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    total = src.count()
    return [_counted(spark, src, Items(block, n), total * common_share) for block in _blocks(rows.toLocalIterator(), block_bytes)]


def _blocks(rows, most: int):
    block, size = [], 0
    for r in rows:
        block.append((r.i, r.t))
        size += len(r.t.encode("utf-8", "replace"))
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counted(spark, src: DataFrame, items: Items, common: float):
    shared = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, df = shared.value, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for table, _, k in items.found(items.coder.codes(t)):
                    df.update((table, g) for g in set(k.tolist()))
        if df:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in df], pa.int32()), pa.array([x for _, x in df], pa.int32()), pa.array(list(df.values()), pa.int64())], names=["size", "g", "n"])

    for r in src.select("t").mapInArrow(count, "size int, g int, n long").groupBy("size", "g").agg(F.sum("n").alias("n")).toLocalIterator():
        items.df[r["size"]][r["g"]] = r["n"]
    items.choose(common)
    return spark.sparkContext.broadcast(items)
