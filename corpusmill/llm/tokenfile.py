"""Token-id files: each document compressed alone with one shared zstandard dictionary.

A file holds shards. A shard is MAGIC, its byte length, the dictionary's SHA-256, the
number of documents, an index of (doc_id, tokens, offset) and the compressed frames in
ascending doc_id order, so a short document is read by one seek and one small frame.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.runtime import Scratch, ship, slices

MAGIC = b"CMTOKEN1"
_HEAD = struct.Struct("<8sQ32sQ")
INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8"), ("offset", "<u8")])
NO_ID = -(1 << 63)
#: Set in the index beside the token count of a document without an id.
_NULL = 1 << 63

#: What the byte-level split never spans: the end of a run of letters before closing ASCII punctuation, and any place
#: where a non-space is followed by a space or line feed.
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TAILED = rf"[{_LETTERS}](?P<tail>[{re.escape(_MARKS)}]+)$"
#: Texts whose words do not stand apart by single spaces or line feeds are taken in chunks. After other white space
#: nothing is cut: libraries differ in what counts as such.
_ODD = "[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\\x00"
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


class ChunkEncoder:
    """The tokenizers library over whole texts, each distinct word encoded once as long as it is remembered.

    Texts are split into words with the white space before them, in Arrow; a word and its
    closing punctuation are encoded apart. Words are kept in two generations of about
    ``keep`` bytes each: when the younger is full it becomes the older, whose entries are
    taken over as they are met. A text that holds one of the vocabulary's added tokens is
    encoded in one piece.
    """

    def __init__(self, definition: str, keep: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tok, self.young, self.old, self.size, self.keep = Tokenizer.from_str(definition), {}, {}, 0, keep
        self.tok.model._resize_cache(0)  # what reaches the library is new each time
        vocab = self.tok.get_vocab()  # byte-level: a token has one character for each byte
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(k) for k in vocab]

    def _encode(self, chunks: list[str]) -> Iterator[bytes]:
        for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def learn(self, words: list[str], before: str, into: dict[str, bytes]) -> None:
        """Encode new words with ``before`` in front of each, in long runs that keep their seams and are cut by byte length."""
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        for run, e in zip(runs, self.tok.encode_batch_fast([before + before.join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            sizes = np.fromiter(map(len, map(str.encode, run)), np.int64, len(run)) + len(before)
            ends = (4 * np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), side="left") + 4).tolist()
            raw = ids.tobytes()
            into.update(zip(run, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words: with a space before them, or as they are behind a zero byte or with a line feed."""
        if self.size > self.keep:
            self.young, self.old, self.size = {}, self.young, 0
        found = list(map(self.young.get, words))
        new = [w for w, v in zip(words, found) if v is None]
        if new:
            fresh = {w: v for w, v in zip(new, map(self.old.get, new)) if v is not None}
            new = [w for w in new if w not in fresh]
            self.learn([w for w in new if w and w[0] not in "\x00\n"], " ", fresh)
            self.learn([w for w in new if len(w) > 1 and w[0] == "\n"], "", fresh)
            own = [w for w in new if w in ("", "\n") or w[0] == "\x00"]
            fresh.update(zip(own, self._encode([w[1:] if w[:1] == "\x00" else w or " " for w in own])))
            self.young.update(fresh)
            self.size += 200 * len(fresh) + sum(map(len, fresh))
            found = list(map(self.young.__getitem__, words))
        return found

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose words stand apart by single spaces or line feeds. A zero byte marks the first word."""
        split = pc.split_pattern(pc.binary_join_element_wise("\x00", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = split.flatten().dictionary_encode()
        # each distinct word is a base and a tail of closing punctuation, or none
        tails = pc.struct_field(pc.extract_regex(coded.dictionary, _TAILED), "tail").fill_null("").dictionary_encode()
        bases = pc.if_else(pc.equal(tails, ""), coded.dictionary, pc.utf8_rtrim(coded.dictionary, _MARKS)).dictionary_encode()
        values = [*self._known(bases.dictionary.to_pylist()), *self._encode(tails.dictionary.to_pylist())]
        length = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        pool, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(length) - length
        parts = np.stack([bases.indices.to_numpy(), tails.indices.to_numpy() + len(bases.dictionary)], axis=1)[coded.indices.to_numpy()].ravel()
        n = length[parts]
        end = np.cumsum(n)
        raw = pool[np.repeat(start[parts] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = [0, *(4 * np.append(0, end)[2 * np.cumsum(pc.list_value_length(split).to_numpy())]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.raws([text])[0]

    def raws(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        out: list[bytes] = [b""] * len(texts)
        at = np.flatnonzero(~odd.to_numpy(zero_copy_only=False)).tolist()
        for k, raw in zip(at, self._spaced(texts.take(pa.array(at, pa.int64()))) if at else []):
            out[k] = raw
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            t = texts[k].as_py()
            if any(x in t for x in self.added):
                out[k] = next(self._encode([t]))
            else:  # chunks as they are, behind a zero byte
                chunks = ["\x00" + c for c in _CHUNK.findall(t)]
                of = dict(zip(new := list(dict.fromkeys(chunks)), self._known(new)))
                out[k] = b"".join(map(of.__getitem__, chunks))
        return out


_ENCODERS: dict[int, ChunkEncoder] = {}


def _encoder(definition: str) -> ChunkEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(definition)
    return _ENCODERS[key]


def _parts(b: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """b in runs of rows whose texts (column 1) have about ``most`` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A zstandard dictionary of at most size bytes; empty when there is too little to learn from."""
    size = min(size, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def pack(rows: Iterable[tuple[int | None, int, bytes]], dictionary: bytes) -> bytes:
    """One shard of (doc_id, tokens, frame) rows in the order given."""
    rows = list(rows)
    index = np.zeros(len(rows), INDEX)
    index["doc_id"] = [NO_ID if r[0] is None else r[0] for r in rows]
    index["n_tokens"] = [r[1] | (_NULL if r[0] is None else 0) for r in rows]
    index["offset"] = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])[:-1]]) if rows else []
    body = index.tobytes() + b"".join(r[2] for r in rows)
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), hashlib.sha256(dictionary).digest(), len(rows)) + body


def unpack(data: bytes | memoryview, dictionary: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, tokens, raw ids) of every shard in a file, checked against the dictionary's hash and the token counts."""
    view, at, unzip = memoryview(data), 0, decompressor(dictionary)
    while at < len(view):
        if view[at] == 10:  # the line feed after a shard
            at += 1
            continue
        magic, size, digest, n = _HEAD.unpack_from(view, at)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token shard, or written with another dictionary")
        index = np.frombuffer(view, INDEX, n, at + _HEAD.size)
        base = at + _HEAD.size + index.nbytes
        ends = [*index["offset"][1:].tolist(), size - _HEAD.size - index.nbytes]
        for doc_id, tokens, a, b in zip(index["doc_id"].tolist(), index["n_tokens"].tolist(), index["offset"].tolist(), ends):
            raw = unzip.decompress(view[base + a : base + b])
            null, tokens = tokens & _NULL, tokens & ~_NULL
            if len(raw) != 4 * tokens:
                raise ValueError(f"document {doc_id}: {len(raw) // 4} ids, the index has {tokens}")
            yield (None if null else doc_id), tokens, raw
        at += size


def read_one(data: bytes, doc_id: int, dictionary: bytes) -> list[int] | None:
    """The ids of one document by the offset index of a file's shards; None if it isn't there."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 10:
            at += 1
            continue
        _, size, _, n = _HEAD.unpack_from(view, at)
        index = np.frombuffer(view, INDEX, n, at + _HEAD.size)
        k = int(np.searchsorted(index["doc_id"], doc_id))
        while k < n and index["doc_id"][k] == doc_id and index["n_tokens"][k] & np.uint64(_NULL):
            k += 1
        if k < n and index["doc_id"][k] == doc_id:
            base = at + _HEAD.size + index.nbytes
            end = int(index["offset"][k + 1]) if k + 1 < n else size - _HEAD.size - index.nbytes
            return np.frombuffer(decompressor(dictionary).decompress(view[base + int(index["offset"][k]) : base + end]), "<u4").tolist()
        at += size
    return None


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 16 << 20, sample_docs: int = 1000, sample_doc_bytes: int = 1 << 16, scratch: Scratch | None = None) -> tuple[str, bytes]:
    """Encode every whole text, append end_id, and write shards; returns their folder and the dictionary.

    tokenizer: a tokenizers JSON file on the driver, sent to the executors (it does not
    grow with the data). The dictionary, which affects sizes only, is trained on the
    whole ids of at most sample_docs documents, those with the smallest hashes of id and
    text among those of at most sample_doc_bytes (it serves short documents). Frames are
    compressed before the one shuffle, which deals them by ranges of doc_id to about one
    shard for shard_bytes of input; an id with more rows than a range is spread over
    several. A null text is empty (the end id only); rows with a null id come first; rows
    of equal id come in an order that depends on the input's layout alone; an empty table
    writes no shard; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    n = slices(spark, docs, shard_bytes)
    placed = F.coalesce("doc_id", F.lit(NO_ID))
    total, bounds = src.agg(F.count("*"), F.percentile_approx(placed, [i / n for i in range(1, n)] or [0.5], 20 * n + 1000)).first()
    bounds = np.array(bounds if n > 1 and bounds else [], np.int64)
    enc = _encoder(definition)
    end = np.array([end_id], "<u4").tobytes()
    h = F.xxhash64("doc_id", "t")
    share = min(1.0, 2 * sample_docs / max(total, 1))
    fits = src.filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= sample_doc_bytes).filter(F.pmod(h, F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    picked = fits.orderBy(h, "doc_id", "t").limit(sample_docs).select("t").collect()
    dictionary = train_dictionary([enc.raw(r.t or "") + end for r in picked])
    shared = spark.sparkContext.broadcast((definition, dictionary, bounds))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.tokenfile import _encoder, _parts, compressor

        definition, dictionary, bounds = shared.value
        enc, zip_, rows = _encoder(definition), compressor(dictionary), 0
        for b in batches:
            for part in _parts(b):
                ids = part.column(0).to_pylist()
                raw = [r + end for r in enc.raws(part.column(1))]
                at = np.array([NO_ID if i is None else i for i in ids], np.int64)
                first, last = np.searchsorted(bounds, at, side="left"), np.searchsorted(bounds, at, side="right")
                # an id that is several bounds at once has the ranges between them to itself
                shard = first + (rows + np.arange(len(at))) % np.maximum(last - first, 1)
                rows += len(at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zip_.compress(r) for r in raw], pa.binary()), pa.array(shard.astype(np.int32))], names=["doc_id", "n_tokens", "frame", "shard"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.tokenfile import pack

        now, rows = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in (3, 0, 1, 2))):
                if now not in (None, shard):
                    yield pa.RecordBatch.from_arrays([pa.array([pack(rows, shared.value[1])], pa.binary())], names=["blob"])
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pack(rows, shared.value[1])], pa.binary())], names=["blob"])

    frames = src.mapInArrow(encode, "doc_id long, n_tokens long, frame binary, shard int")
    shards = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n_tokens", "frame").mapInArrow(write, "blob binary")
    return scratch.blobs(shards, "shards"), dictionary


def read_token_files(spark, path: str, dictionary: bytes) -> DataFrame:
    """(file, doc_id, n_tokens, before, ids_crc32, first_id) of every document in the files of a folder.

    before counts the ids of earlier documents in the same file; first_id is the file's
    smallest doc_id (null ids first), by which files are in order.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(dictionary)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.tokenfile import NO_ID, unpack

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                ids, n, crc, before, total = [], [], [], [], 0
                for doc_id, tokens, raw in unpack(data.as_buffer(), shared.value):
                    ids.append(doc_id)
                    n.append(tokens)
                    crc.append(zlib.crc32(raw))
                    before.append(total)
                    total += tokens
                if ids:
                    first = NO_ID if ids[0] is None else ids[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(crc, pa.int64()), pa.array([first] * len(ids), pa.int64())], names=["file", "doc_id", "n_tokens", "before", "ids_crc32", "first_id"])

    return spark.read.format("binaryFile").load(path).filter("length > 1").select("path", "content").mapInArrow(parse, "file string, doc_id long, n_tokens long, before long, ids_crc32 long, first_id long")


def positions(read: DataFrame, scratch: Scratch) -> DataFrame:
    """read_token_files with start: the ids of all documents before this one in ascending doc_id order.

    Only one row a file is summed in order; files are joined back by name.
    """
    read = scratch.table(read, "read")
    totals = read.groupBy("file", "first_id").agg(F.sum("n_tokens").alias("n"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")  # ranges of one id lie in several files
    starts = totals.select("file", (F.sum("n").over(W.orderBy("first_id", part, "file")) - F.col("n")).alias("offset"))
    return read.join(starts, "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
