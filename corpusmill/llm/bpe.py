"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves: each half is encoded recursively, and neighbours are
joined by re-encoding a window around the seam that grows until the tokens outside
it provably stay. For a text that holds between two places where a non-space is
followed by a space or line feed: no pre-token spans such a place, and what precedes
or follows it never changes how the other side is split. Inside a single pre-token
without such places, a sequence of tokens is the encoding of its bytes if and only if
every neighbouring pair of tokens encodes to itself, so the window there grows until
the pairs at both of its edges do. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship

#: White space of the pre-token pattern; a seam lies between a non-space and a space or line feed.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEAM = re.compile(f"(?<=[^{_SPACE}])(?=[ \n])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary; leaf: characters (or bytes of a single pre-token) encoded at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 1024, piece_leaf: int = 512):
        self.base = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.ranks, self.leaf, self.piece_leaf = regex.compile(pattern), ranks, leaf, piece_leaf
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}

    # -- texts ---------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return self._range(text, 0, len(text))

    def _range(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        p, q = self._seam_before(text, lo, mid), self._seam_after(text, mid, hi)
        if p == lo and q == hi:  # the window has grown to the whole range
            return self._pieces(text[lo:hi])
        left, right = self._range(text, lo, mid), self._range(text, mid, hi)
        out = len(self._plain(text[p:mid])), len(self._plain(text[mid:q]))
        return left[: len(left) - out[0]] + self._plain(text[p:q]) + right[out[1] :]

    def _seam_before(self, text: str, lo: int, mid: int) -> int:
        w = 64
        while True:
            a = max(lo, mid - w)
            at = None
            for m in _SEAM.finditer(text, a, mid):
                if m.start() > lo:
                    at = m.start()
            if at is not None or a == lo:
                return lo if at is None else at
            w *= 4

    def _seam_after(self, text: str, mid: int, hi: int) -> int:
        m = _SEAM.search(text, mid, hi)
        return m.start() if m and m.start() > mid else (hi if not m else self._next(text, m.start() + 1, hi))

    def _next(self, text: str, at: int, hi: int) -> int:
        m = _SEAM.search(text, at, hi)
        return m.start() if m else hi

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.base.encode_ordinary(text)
        return self._pieces(text)

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.encode_piece(m[0].encode("utf-8"))
        return out

    # -- one pre-token -------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece_leaf:
            return self.whole._core_bpe.encode_single_piece(piece)
        mid = len(piece) // 2
        return self.join(self.encode_piece(piece[:mid]), self.encode_piece(piece[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes as one pre-token."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            mid = self.whole._core_bpe.encode_single_piece(b"".join(self.bytes_of[t] for t in [*a, *b]))
            if (k >= len(left) or self.stable(left[-k - 1], mid[0])) and (k >= len(right) or self.stable(mid[-1], right[k])):
                return left[:-k] + mid + right[k:]
            k *= 2

    def stable(self, a: int, b: int) -> bool:
        """True if the two tokens' bytes encode to just these tokens."""
        if (got := self._stable.get((a, b))) is None:
            if len(self._stable) > 200_000:
                self._stable.clear()
            got = self._stable[a, b] = self.whole._core_bpe.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    # -- back ----------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[str, Codec] = {}


def _codec(key: str, ranks, pattern: str) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, ids binary, n_tokens, ids_sha256, decoded_sha256) for every row of docs.

    ids are little-endian unsigned 32-bit integers of the whole text (null: empty, no
    ids); decoded_sha256 is over the bytes that the ids decode to. vocabulary is a file
    of base64 tokens and ranks on the driver; its ranks are broadcast (a vocabulary does
    not grow with the data). Rows are independent: no shuffle, repeated rows and null
    ids pass through, an empty table gives an empty result, other columns are not read.
    ids=False leaves the ids column out.
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    key = f"{vocabulary}\0{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.bpe import _codec

        codec = _codec(key, ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], []]
                for t in part.column(1).to_pylist():
                    tokens = codec.encode(t or "")
                    raw = np.array(tokens, dtype="<u4").tobytes()
                    cols[0].append(raw if ids else None)
                    cols[1].append(len(tokens))
                    cols[2].append(hashlib.sha256(raw).hexdigest())
                    cols[3].append(hashlib.sha256(codec.decode(tokens)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out if ids else out.drop("ids")
