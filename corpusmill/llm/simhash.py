"""SimHash fingerprints and exact linking within a Hamming radius by covering locality-sensitive hashing.

Every bit position gets a non-zero vector phi(i) of r+1 bits. Table v (a non-zero
vector of r+1 bits) keys a fingerprint by the bits whose phi(i) has odd inner
product with v. At most r positions differ in a linked pair, their phi span at most
r dimensions, so some v is orthogonal to all of them: the pair agrees in that
table's whole key, with certainty rather than with a probability.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components, forest
from corpusmill.runtime import Scratch, ship

SEED = 42
#: A bucket with so many free bits is never split, as it has at most 2**FREE members.
FREE = 16
#: Keys that a task sorts and links.
KEYS = 1 << 20


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = words_per_shingle
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, h = b" ".join(words), xxhash.xxh64_intdigest
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-k])]
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])]
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer. Only these two columns are read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, words_per_shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


@lru_cache
def spread(n: int, radius: int) -> tuple[int, ...]:
    """phi of n positions: each non-zero v has an odd product with about half of them.

    Where there are fewer positions than values, the best of some choices is taken: the
    values with the top bit (for 64 positions and radius 6, every v then keys 32 bits or
    all), and seeded samples.
    """
    most = 2 ** (radius + 1) - 1
    if n >= most:
        return tuple(i % most + 1 for i in range(n))
    rng = random.Random(n)
    choices = [rng.sample(range(1, most + 1), n) for _ in range(400)]
    if n <= 1 << radius:
        choices.append([(1 << radius) + i for i in range(n)])
    v = np.arange(1, most + 1)[:, None]
    return tuple(max(choices, key=lambda c: int((np.bitwise_count(np.array(c, dtype=np.int64) & v) % 2).sum(axis=1).min()) if n else 0))


def covering_masks(positions: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """For each table: the mask of its key bits, and the positions left free."""
    phi = dict(zip(positions, spread(len(positions), radius)))
    out = []
    for v in range(1, 2 ** (radius + 1)):
        keyed = [p for p in positions if (phi[p] & v).bit_count() % 2]
        out.append((sum(1 << p for p in keyed), [p for p in positions if p not in set(keyed)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(masks: list[tuple[int, list[int]]]) -> Column:
    """One literal array of (table, mask), exploded."""
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, (m, _) in enumerate(masks)])).alias("k")


def _finer(masks: list[int], radius: int) -> list[tuple[int, int]]:
    """(mask, mask that keys more bits) for all covering masks over each mask's free bits."""
    out = set()
    for m in masks:
        free = [p for p in range(64) if not m >> p & 1]
        out |= {(m, _signed(m & (1 << 64) - 1 | finer)) for finer, _ in covering_masks(free, radius)}
    return sorted(out)


def _bucket(table: str, mask: str) -> Column:
    """A fingerprint's bucket as one number; two buckets that share it are merely compared as one."""
    return F.xxhash64(F.col(table), F.col("fp").bitwiseAND(F.col(mask))).alias("h")


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that are links and connect exactly what all links among fps connect."""
    fps = fps.view(np.uint64) if fps.dtype == np.int64 else fps
    rest, out = np.arange(1, len(fps)), []
    queue = [0]
    while len(rest) or queue:
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        i = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[i]) <= radius
        if near.any():
            found = rest[near].tolist()
            out += [(i, j) for j in found]
            queue += found
            rest = rest[~near]
    return out


def _links(h: np.ndarray, fps: np.ndarray, radius: int, few: int = 16) -> list[tuple[int, int]]:
    """Linked fingerprints of whole buckets that stand one behind the other."""
    at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    size = np.diff(at)
    small = np.repeat((size > 1) & (size <= few), size)
    hs, fs = h[small], fps[small].view(np.uint64)
    pairs = []
    for d in range(1, few):
        i = np.flatnonzero(hs[d:] == hs[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(fs[i] ^ fs[i + d]) <= radius]
        pairs.append(np.stack([fs[i], fs[i + d]], axis=1).view(np.int64))
    found = list(map(tuple, np.unique(np.concatenate(pairs), axis=0).tolist())) if pairs else []
    for k in np.flatnonzero(size > few).tolist():
        part = fps[at[k] : at[k + 1]]
        found += [(int(part[i]), int(part[j])) for i, j in spanning_links(part, radius)]
    return found


def _bucket_links(radius: int):
    """Rows (h, fp) in order of h to star links; a bucket is held whole, never two batches' worth more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def stars(pairs):
            got = forest(pairs)
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([top for _, top in got], pa.int64())], names=["a", "b"])

        for b in batches:
            h = np.concatenate([h, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(h, h[-1], side="left")) if len(h) else 0
            if last:
                yield stars(_links(h[:last], fps[:last], radius))
                h, fps = h[last:], fps[last:]
        if len(h):
            yield stars(_links(h, fps, radius))

    return run


def _hot_cells(keys: DataFrame, number: int, bucket: int) -> tuple[Column, list[int]]:
    """A coarse cell of each bucket, and the cells with more than ``bucket`` rows.

    A bucket lies whole in one cell, so one in any other cell is small. Cells are counted
    with map-side combine and hold a fraction of ``bucket`` rows on average, so next to
    none but those of large buckets are named; there are at most number / bucket.
    """
    cells = 1 << max(12, (8 * number // bucket).bit_length())
    cell = F.pmod("h", F.lit(cells))
    return cell, [r["c"] for r in keys.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > bucket).collect()]


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words_per_shingle: int = 3, bucket: int = 1 << 16) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and
    component_id is the smallest doc_id reachable by links. Equal fingerprints are
    collapsed first (combined map-side), so copies cost one row. The keys of all tables
    are shuffled once, by bucket, and linked bucket by bucket as they stream by. Buckets
    of more than ``bucket`` distinct fingerprints, found beforehand by a coarse count, are
    keyed anew by covering masks over their free bits, again and again until they are
    small or have at most 16 free bits, so no task ever holds more than the larger of
    ``bucket`` and 2**16 distinct members of a bucket and none is cut. Only masks of
    buckets that are too large get new ones, and only those are broadcast.

    Null or empty texts have fingerprint 0 and are linked like any other; rows with a
    null doc_id follow their fingerprint's group (null if all its ids are null);
    repeated rows are repeated; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    classes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    first = covering_masks(list(range(64)), radius)
    keys = classes.filter("rep is not null").select("fp", _masks(first)).select(_bucket("k.t", "k.m"), "fp")
    distinct = classes.count()
    number = distinct * len(first)
    # no bucket has more members than there are fingerprints
    cell, large = _hot_cells(keys, number, bucket) if distinct > bucket else (None, [])
    small, used = [keys], []
    if large:
        cells = F.broadcast(spark.createDataFrame([(x,) for x in large], "c long"))
        small = [keys.withColumn("c", cell).join(cells, "c", "left_anti").select("h", "fp")]
        again = keys.withColumn("c", cell).join(cells, "c", "left_semi").select("h", "fp")
        again = scratch.table(again.join(again.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h"), "shared0")
        small.append(again.filter(F.col("n") <= bucket).select("h", "fp"))
        used.append("shared0")
        hot = again.filter(F.col("n") > bucket).select("fp", F.col("h").alias("h1"), _masks(first)).filter(_bucket("k.t", "k.m") == F.col("h1")).select("fp", F.col("k.m").alias("of"))
        while True:
            used.append(f"hot{len(used)}")
            hot = scratch.table(hot, used[-1])
            finer = [row["of"] for row in hot.select("of").distinct().collect()]
            if not finer:
                break
            masks = spark.createDataFrame(_finer(finer, radius), "of long, m long")
            again = hot.join(F.broadcast(masks), "of").select("fp", "m").distinct().select("fp", "m", _bucket("m", "m"))
            used.append(f"shared{len(used)}")
            again = scratch.table(again.join(again.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h"), used[-1])
            done = (F.col("n") <= bucket) | (F.bit_count("m") >= 64 - FREE)
            small.append(again.filter(done).select("h", "fp"))
            hot = again.filter(~done).select("fp", F.col("m").alias("of"))
    dealt = reduce(DataFrame.union, small).repartition(1 + number // KEYS, F.col("h")).sortWithinPartitions("h")
    comps = components(dealt.mapInArrow(_bucket_links(radius), "a long, b long"), scratch, contracted=True)
    for name in used:
        scratch.drop(name)
    named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
