"""Trigram language model in Elias-Fano tries.

The corpus is counted in blocks; a block sends each shard one compact row of its words,
bigrams and trigrams, so counting is one shuffle of pre-aggregated keys. Bigrams go by
the hash of their context, a word, and trigrams by that of theirs, a pair, so a frequent
word's trigrams spread over all shards. For either order a shard holds a level of sorted
context hashes with backoff weights (and counts for words), and a level of successors. A
successor's key is mixed from its context's rank and its own hash, so keys are evenly
spread however many successors a context has. All levels are Elias-Fano coded: low bits
packed, high parts in unary. Every n-gram counted is kept.
A successor that was never seen is taken for another with a chance of about 2**-20, a
pair for another with one of (pairs in the shard) / 2**40.
Discounted probabilities and backoff weights are quantised to one byte. Scoring maps
the shard files into memory; nothing of the model is held in an executor's heap.

Probabilities are interpolated with absolute discounting, one discount an order and shard:
p(w|v) = max(c(vw) - D, 0) / c(v) + b(v) * (c(w) + 1) / (N + V + 1),
p(w|uv) = max(c(uvw) - D, 0) / c(uv) + b(uv) * p(w|v).
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import Scratch, ship, slices

U = np.uint64
END, START = 0x1D4F3A9B7C5E2081, 0x6B8E0F2D4C9A7135  # hashes of the end token and of the start context
KEY_BITS = 40  # of a word within its context, and of a pair within its shard
LAST_BITS = 32  # of a word after a pair
LONG = 64  # bytes of a word from which on it is hashed alone
SURE_BITS = 20  # of a successor's key beyond those that number its level
MAGIC = b"CMTRIE02"


# -- Elias-Fano ---------------------------------------------------------------
def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of width bits each, one behind the other, in 64-bit words."""
    out = np.zeros((len(values) * width + 63) // 64 + 2, U)
    if width and len(values):
        at = np.arange(len(values), dtype=U) * U(width)
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(out, word, values << off)
        over = off + U(width) > U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - off[over]))
    return out


def _unpack(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U)
    at = i.astype(U) * U(width)
    word, off = (at >> U(6)).astype(np.int64), at & U(63)
    v = words[word] >> off
    over = off > 0
    v[over] |= words[word[over] + 1] << (U(64) - off[over])
    return v & ((U(1) << U(width)) - U(1)) if width < 64 else v


class EliasFano:
    """A sorted sequence of unsigned keys below 2**bits, searched without being expanded."""

    STEP = 64  # high parts between two directory entries

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.width, self.low, self.high, self.directory = n, width, low, high, directory

    @classmethod
    def encode(cls, keys: np.ndarray, bits: int) -> EliasFano:
        n = len(keys)
        width = max(0, bits - max(n, 1).bit_length())
        top = (keys >> U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        places = (1 << (bits - width)) if bits > width else 1
        ones = top + np.arange(n)
        raw = np.zeros(((n + places) // 64 + 3) * 64, np.uint8)
        raw[ones] = 1
        high = np.packbits(raw, bitorder="little").view("<u8")
        directory = np.searchsorted(top, np.arange(0, places + cls.STEP, cls.STEP), side="left").astype(np.uint32)
        low = _pack(keys & ((U(1) << U(width)) - U(1)) if width < 64 else keys, width)
        return cls(n, width, low, high, directory)

    def _window(self, pos: np.ndarray) -> np.ndarray:
        """64 bits of the unary part from each position."""
        word, off = pos >> 6, (pos & 63).astype(U)
        nxt = np.minimum(word + 1, len(self.high) - 1)
        return np.where(off > 0, (self.high[word] >> off) | (self.high[nxt] << ((U(64) - off) & U(63))), self.high[word])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key (the first of equal ones), or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        top = (keys >> U(self.width)).astype(np.int64)
        low = keys & ((U(1) << U(self.width)) - U(1))
        block = top // self.STEP
        pos = self.directory[block].astype(np.int64) + block * self.STEP
        left = top - block * self.STEP  # zeros to pass to reach this high part's run of ones
        act = np.flatnonzero(left > 0)
        while len(act):
            w = ~self._window(pos[act])
            zeros = np.bitwise_count(w).astype(np.int64)
            far = zeros < left[act]
            pos[act[far]] += 64
            left[act[far]] -= zeros[far]
            near = act[~far]
            w, need, at = w[~far], left[near].copy(), np.zeros(len(near), np.int64)
            for half in (32, 16, 8, 4, 2, 1):  # position of the need-th zero in the window
                part = w & U((1 << half) - 1)
                c = np.bitwise_count(part).astype(np.int64)
                go = c < need
                need = np.where(go, need - c, need)
                at = np.where(go, at + half, at)
                w = np.where(go, w >> U(half), part)
            pos[near] += at + 1
            act = act[far]
        rank = pos - top
        act = np.arange(len(keys))
        while len(act):  # the run of keys with this high part
            word = self.high[pos[act] >> 6] >> (pos[act] & 63).astype(U)
            act = act[(word & U(1)).astype(bool)]
            same = _unpack(self.low, rank[act], self.width) == low[act]
            out[act[same]] = rank[act[same]]
            act = act[~same]
            pos[act] += 1
            rank[act] += 1
        return out

    def dump(self) -> list[bytes]:
        parts = [self.low.astype("<u8").tobytes(), self.high.astype("<u8").tobytes(), self.directory.astype("<u4").tobytes()]
        parts[2] += b"\0" * (-len(parts[2]) % 8)
        return [struct.pack("<QQQQQ", self.n, self.width, len(self.low), len(self.high), len(self.directory)), *parts]

    @classmethod
    def load(cls, data, at: int) -> tuple[EliasFano, int]:
        n, width, a, b, c = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        low = np.frombuffer(data, "<u8", a, at)
        high = np.frombuffer(data, "<u8", b, at + 8 * a)
        directory = np.frombuffer(data, "<u4", c, at + 8 * (a + b))
        return cls(n, width, low, high, directory), at + 8 * (a + b) + c * 4 + (-c * 4) % 8


# -- quantisation -------------------------------------------------------------
def quantise(values: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codebook of bins values, one byte each): bins of equally many distinct values, each told by its mean.

    Most n-grams share a few values, so bins of equal mass would leave the others a handful of bins.
    """
    if not len(values):
        return np.zeros(bins), np.zeros(0, np.uint8)
    edges = np.unique(np.quantile(np.unique(values), np.linspace(0, 1, bins + 1)[1:-1]))
    code = np.searchsorted(edges, values, side="right")
    total = np.bincount(code, values, bins)
    count = np.bincount(code, minlength=bins)
    return np.where(count > 0, total / np.maximum(count, 1), 0.0), code.astype(np.uint8)


# -- blocks of tokens ---------------------------------------------------------
def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, eight bytes at a time over all strings together; of long ones by xxHash."""
    offsets = np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    start, size = offsets[:-1], np.diff(offsets)
    h = size.astype(U)
    for k in range(0, LONG, 8):
        act = np.flatnonzero((size > k) & (size <= LONG))
        if not len(act):
            break
        left = np.minimum(size[act] - k, 8).astype(U)
        h[act] = mixed(h[act], lanes[start[act] + k] & (~U(0) >> (U(64) - U(8) * left)))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return h


class Block:
    """Token numbers of some documents, and the hashes of their distinct words. 0 is the end, 1 the start context."""

    def __init__(self, texts: pa.Array | list[str | None]):
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not filled.all():  # white space at either end of a text leaves empty words
            flat, ends = flat.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[ends]
        coded = flat.dictionary_encode()
        self.sizes = np.diff(ends, prepend=0) + 1
        self.tokens = np.zeros(int(self.sizes.sum()), np.int32)
        last = np.cumsum(self.sizes) - 1
        inside = np.ones(len(self.tokens), bool)
        inside[last] = False
        self.tokens[inside] = coded.indices.to_numpy(zero_copy_only=False) + 2
        self.hash = np.concatenate([np.array([END, START], U), word_hashes(coded.dictionary)])
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[np.concatenate([[0], last[:-1] + 1])[: len(last)]] = 1
        del split, flat, coded, inside
        n = len(self.hash)
        pair, pair_of, self.pair_times = np.unique(self.context.astype(np.int64) * n + self.tokens, return_inverse=True, return_counts=True)
        self.pair_of = pair_of.astype(np.int32)
        del pair_of
        self.left, self.right = pair // n, pair % n
        self.pair_hash = mixed(self.hash[self.left], self.hash[self.right])
        self.inner = np.flatnonzero(self.context != 1).astype(np.int32)  # tokens with two before them, the start counted
        triple, triple_of, self.triple_times = np.unique(self.pair_of[self.inner - 1].astype(np.int64) * n + self.tokens[self.inner], return_inverse=True, return_counts=True)
        self.triple_of = triple_of.astype(np.int32)
        self.before, self.last = triple // n, triple % n  # a pair's number, a word's


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers each."""
    h = (a.astype(U) + U(0x9E3779B97F4A7C15)) * U(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> U(31))) + b.astype(U)) * U(0x94D049BB133111EB)
    h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


def successor_key(h: np.ndarray) -> np.ndarray:
    return (h * U(0x9E3779B97F4A7C15)) >> U(64 - KEY_BITS)


def last_key(h: np.ndarray) -> np.ndarray:
    return successor_key(h) >> U(KEY_BITS - LAST_BITS)


def pair_key(h: np.ndarray) -> np.ndarray:
    return h >> U(64 - KEY_BITS)


def level_key(rank: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Key of a successor in a level of n, out of its context's rank and its own key."""
    return mixed(rank, key) >> U(64 - SURE_BITS - n.bit_length())


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (columns 0 and 1) in runs of rows with about ``most`` bytes of text."""
    parts, size = [], 0

    def joined():
        return pa.concat_arrays([p.column(0) for p in parts]), pa.concat_arrays([p.column(1) for p in parts])

    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(b.num_rows, int(np.searchsorted(ends, before + most - size, side="left")) + 1)
            parts.append(b.slice(at, end - at))
            size += int(ends[end - 1]) - before
            at = end
            if size >= most:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, places ordered by value, ends of each value's run of places)."""
    order = np.argsort(values, kind="stable")
    present, first = np.unique(values[order], return_index=True)
    return present, order, np.append(first, len(values))


# -- counting -----------------------------------------------------------------
def _dealt(shards: int, shard: np.ndarray, key: np.ndarray, keep: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    """(contexts by shard and key, how many successors each has, successors in that order, ends of each shard in either)."""
    order = np.lexsort((key, shard))
    order = order[keep[order]]
    place = np.zeros(len(key), np.int64)
    place[order] = np.arange(len(order))
    runs = np.bincount(context, minlength=len(key))[order]
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    return order, runs, np.argsort(place[context], kind="stable"), ends, np.append(0, np.cumsum(runs))[ends]


def _low(keys: np.ndarray, size: int) -> bytes:
    """The low bytes of keys."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _high(data, n: int, size: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel()


def _gaps(tops: np.ndarray) -> bytes:
    """Sorted 16-bit numbers as two planes of their gaps, which pack well."""
    return np.diff(tops, prepend=U(0)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _tops(data, n: int, at: int) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint8, 2 * n, at).reshape(2, n).astype(U)
    return np.cumsum(low | high << U(8), dtype=U)


def _requests(block: Block, shards: int) -> Iterator[tuple[int, bytes]]:
    """For each shard: its words with counts, its pairs, and the successors of both with counts."""
    count = np.bincount(block.tokens, minlength=len(block.hash))
    seen = count > 0
    seen[1] = True
    key, last, pair = successor_key(block.hash)[block.right], last_key(block.hash)[block.last], pair_key(block.pair_hash)
    follows = np.zeros(len(pair), bool)
    follows[block.before] = True
    w, wruns, b, wends, bends = _dealt(shards, (block.hash % U(shards)).astype(np.int64), block.hash, seen, block.left)
    p, pruns, t, pends, tends = _dealt(shards, (block.pair_hash % U(shards)).astype(np.int64), pair, follows, block.before)
    pack = zstandard.ZstdCompressor(level=1).compress
    for s in np.flatnonzero((np.diff(wends) > 0) | (np.diff(pends) > 0)).tolist():
        ws, bs, ps, ts = (slice(e[s], e[s + 1]) for e in (wends, bends, pends, tends))
        counts = np.concatenate([count[w[ws]], wruns[ws], block.pair_times[b[bs]], pruns[ps], block.triple_times[t[ts]]])
        h, k = block.hash[w[ws]], pair[p[ps]]
        keys = _low(h, 6) + _low(key[b[bs]], 5) + _low(k, 3) + _low(last[t[ts]], 4)
        yield s, struct.pack("<IIII", ws.stop - ws.start, bs.stop - bs.start, ps.stop - ps.start, ts.stop - ts.start) + keys + pack(_gaps(h >> U(48)) + _gaps(k >> U(KEY_BITS - 16)) + counts.astype("<u4").tobytes())


def _merge(blobs: list[bytes]) -> tuple[tuple, tuple, np.ndarray]:
    """For words and for pairs (context keys, context numbers, successor keys, counts) of a shard; then the words' counts."""
    parts: list[list[np.ndarray]] = [[] for _ in range(9)]
    for blob in blobs:
        n, m, k, t = struct.unpack_from("<IIII", blob)
        at = np.cumsum([16, 6 * n, 5 * m, 3 * k, 4 * t]).tolist()
        rest = zstandard.ZstdDecompressor().decompress(blob[at[4] :])
        counts, runs, times, pruns, ptimes = np.split(np.frombuffer(rest, "<u4", offset=2 * (n + k)), np.cumsum([n, n, m, k]))
        words = _high(blob, n, 6, at[0]) | _tops(rest, n, 0) << U(48)
        pairs = _high(blob, k, 3, at[2]) | _tops(rest, k, 2 * n) << U(KEY_BITS - 16)
        for part, v in zip(parts, (words, runs, _high(blob, m, 5, at[1]), times, pairs, pruns, _high(blob, t, 4, at[3]), ptimes, counts)):
            part.append(v)
    words, runs, key, times, pairs, pruns, last, ptimes, counts = map(np.concatenate, parts)
    first, second = _level(words, runs, key, times, KEY_BITS), _level(pairs, pruns, last, ptimes, LAST_BITS)
    return first, second, np.bincount(np.searchsorted(first[0], words), counts, len(first[0])).astype(np.int64)


def _level(contexts: np.ndarray, runs: np.ndarray, key: np.ndarray, times: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    h = np.unique(contexts)
    if len(h) >> (64 - bits):
        raise ValueError("a shard is too large: lower shard_bytes")
    full = (np.repeat(np.searchsorted(h, contexts), runs).astype(U) << U(bits)) | key
    order = np.argsort(full)
    full = full[order]
    first = np.flatnonzero(np.append(True, full[1:] != full[:-1])[: len(full)])
    times = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return h, (full[first] >> U(bits)).astype(np.int64), full[first] & U((1 << bits) - 1), times


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def _dump_level(h: np.ndarray, ctx: np.ndarray, key: np.ndarray, times: np.ndarray, bits: int) -> list[bytes]:
    total = np.bincount(ctx, times, len(h))
    n1, n2 = int((times == 1).sum()), int((times == 2).sum())
    d = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    book, code = quantise(np.log10((times - d) / total[ctx]))
    backoff = np.where(total > 0, 1 - np.bincount(ctx, 10 ** book[code], len(h)), 1.0)
    bbook, bcode = quantise(np.log10(np.clip(backoff, 1e-6, 1.0)))
    place = level_key(ctx, key, len(key))
    order = np.argsort(place)
    places = EliasFano.encode(place[order], SURE_BITS + len(key).bit_length())
    return [book.astype("<f8").tobytes(), bbook.astype("<f8").tobytes(), *EliasFano.encode(h, bits).dump(), _pad(bcode.tobytes()), *places.dump(), _pad(code[order].tobytes())]


def build_shard(shard: int, blobs: list[bytes]) -> bytes:
    """The trie file of one shard."""
    words, pairs, c = _merge(blobs)
    size = 4 if c.max(initial=0) < 1 << 32 else 8  # the head names the width
    head = [MAGIC, struct.pack("<QQQQQ", shard, int(c.sum()), int((c > 0).sum()), len(c), size), _pad(c.astype(f"<u{size}").tobytes())]
    return b"".join([*head, *_dump_level(*words, 64), *_dump_level(*pairs, KEY_BITS)])


# -- the mapped model ---------------------------------------------------------
class Shard:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if data[:8] != MAGIC:
            raise ValueError(f"{path} holds no trie")
        self.number, self.tokens, self.types, n, size = struct.unpack_from("<QQQQQ", data, 8)
        self.count = np.frombuffer(data, f"<u{size}", n, 48)
        self.words, at = Level.load(data, 48 + size * n + -(size * n) % 8)
        self.pairs, at = Level.load(data, at)


class Level:
    """The contexts of one order and their successors."""

    @classmethod
    def load(cls, data, at: int) -> tuple[Level, int]:
        s = cls()
        s.book, s.bbook = np.frombuffer(data, "<f8", 256, at), np.frombuffer(data, "<f8", 256, at + 2048)
        s.contexts, at = EliasFano.load(data, at + 4096)
        n = s.contexts.n
        s.bcode = np.frombuffer(data, np.uint8, n, at)
        s.successors, at = EliasFano.load(data, at + n + (-n) % 8)
        n = s.successors.n
        s.code = np.frombuffer(data, np.uint8, n, at)
        return s, at + n + (-n) % 8

    def share(self, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Discounted probability of each successor below its context's rank, 0 for one not seen."""
        out = np.zeros(len(rank))
        at = np.flatnonzero(rank >= 0)
        r = self.successors.find(level_key(rank[at], key[at], self.successors.n))
        out[at[r >= 0]] = (10**self.book)[self.code[r[r >= 0]]]
        return out

    def backoff(self, rank: np.ndarray) -> np.ndarray:
        out = np.ones(len(rank))
        out[rank >= 0] = (10**self.bbook)[self.bcode[rank[rank >= 0]]]
        return out


class Model:
    def __init__(self, paths: list[str], shards: int):
        self.shards: list[Shard | None] = [None] * shards
        for p in paths:
            s = Shard(p)
            self.shards[s.number] = s
        got = [s for s in self.shards if s]
        self.tokens, self.types = sum(s.tokens for s in got), sum(s.types for s in got)

    def _look_up(self, level: str, hashes: np.ndarray, contexts: np.ndarray, of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank in its shard or -1, backoff weight) of each context, and the share of each successor key below context number ``of``."""
        shard = (hashes % U(len(self.shards))).astype(np.int64)
        rank, back, share = np.full(len(hashes), -1, np.int64), np.ones(len(hashes)), np.zeros(len(of))
        present, order, ends = _groups(shard)
        by = np.argsort(shard[of], kind="stable")
        gends = np.searchsorted(shard[of][by], np.append(present, len(self.shards)))
        for k, a, b, c, d in zip(present.tolist(), ends[:-1], ends[1:], gends[:-1], gends[1:]):
            if self.shards[k] is None:
                continue
            s, at, g = getattr(self.shards[k], level), order[a:b], by[c:d]
            rank[at] = s.contexts.find(contexts[at])
            back[at] = s.backoff(rank[at])
            share[g] = s.share(rank[of[g]], key[g])
        return rank, back, share

    def score(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each document in the block."""
        rank, back, share = self._look_up("words", block.hash, block.hash, block.left, successor_key(block.hash)[block.right])
        count = np.zeros(len(rank))
        present, order, ends = _groups((block.hash % U(len(self.shards))).astype(np.int64))
        for k, a, b in zip(present.tolist(), ends[:-1], ends[1:]):
            at = order[a:b][rank[order[a:b]] >= 0]
            if len(at):
                count[at] = self.shards[k].count[rank[at]]
        p1 = (count + 1) / (self.tokens + self.types + 1)
        p = (share + back[block.left] * p1[block.right])[block.pair_of]
        _, back, share = self._look_up("pairs", block.pair_hash, pair_key(block.pair_hash), block.before, last_key(block.hash)[block.last])
        p[block.inner] = share[block.triple_of] + back[block.pair_of[block.inner - 1]] * p[block.inner]
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = lambda v: np.bincount(doc, v, len(block.sizes))
        return total(count[block.tokens] > 0).astype(np.int64), total(np.log10(p1)[block.tokens]), total(np.log10(p))


_MODELS: dict[str, Model] = {}


def _model(root: str, files: list[str], shards: int, local: bool) -> Model:
    if root not in _MODELS:
        _MODELS.clear()
        _MODELS[root] = Model(files if local else [os.path.join(SparkFiles.get(os.path.basename(root)), os.path.basename(f)) for f in files], shards)
    return _MODELS[root]


def train(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, block_bytes: int = 12 << 20) -> tuple[str, int]:
    """Count docs and write the trie files; returns their folder and the number of shards."""
    spark = docs.sparkSession
    ship(spark)
    n = slices(spark, docs, shard_bytes)
    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches, block_bytes):
            rows = list(_requests(Block(texts), n))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now not in (None, s):
                    raise ValueError("a partition holds one shard")
                now = s
                blobs.append(blob)
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array([build_shard(now, blobs)], pa.binary())], names=["blob"])

    return scratch.blobs(src.mapInArrow(count, "shard int, blob binary").repartitionById(n, F.col("shard")).mapInArrow(write, "blob binary"), "trie"), n


def score(docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Texts are lower-cased in ASCII and split at ASCII white space; one end token
    follows, so a null or empty text scores its end alone. Rows are independent: no
    shuffle. The driver handles the names of the trie files only; executors map them
    from the shared folder, or fetch them once each where that is not a local path.
    Repeated rows and null ids pass through; an empty table gives an empty result, an
    empty training set the uniform base; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    files = [r.path for r in spark.read.format("binaryFile").load(folder).filter("length > 1").select("path").collect()]
    local = urlparse(folder).scheme in ("", "file")
    if local:
        files = [unquote(urlparse(f).path) for f in files]
    else:
        spark.sparkContext.addFile(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.ngram_lm import Block, _blocks, _model

        model = _model(folder, files, shards, local)
        for ids, texts in _blocks(batches, block_bytes):
            block = Block(texts)
            known, base, total = model.score(block)
            yield pa.RecordBatch.from_arrays([ids, pa.array(block.sizes), pa.array(known), pa.array(np.full(len(ids), model.tokens, np.int64)), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
