"""WARC archives: writing with revisits and segments, reading with reassembly and de-chunking.

A payload travels as an HTTP response with chunked transfer framing. A block longer
than the segment size is cut into segments: the first is a response, the others are
continuation records that name it as their origin, and the last one gives the total
length. The reader decodes whole records where it finds them; only segments are
shuffled, by origin, ordered by number, checked to be gapless and of the total length,
and then decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import Scratch, ship

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Size of a bitmap that tells rows apart (8 MiB).
BITS = 1 << 26


def chunked(payload: bytes, size: int = 4096) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over, a broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, out of its transfer framing."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the second of its two closing line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + CRLF + block + CRLF


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _fields(key: int | None, uri: str, digest: str) -> list[tuple[str, str]]:
    return [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Key", "" if key is None else str(key)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def revisit(key: int, uri: str, digest: str, length: int, refers_to: int, name: str, target: str | None = None) -> bytes:
    """A record that stands for a payload stored before; target is the name of that one's record where it is known."""
    to = [] if target is None else [("WARC-Refers-To", _urn(f"{target}/0"))]
    profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *to, ("X-Refers-To-Key", str(refers_to)), ("X-Payload-Length", str(length))]
    return record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(f"{name}/0")), *_fields(key, uri, digest), *profile], b"HTTP/1.1 200 OK\r\n\r\n")


def records(key: int | None, uri: str, payload: bytes, segment: int, name: str | None = None) -> Iterator[bytes]:
    """The records of one payload, in segments where it is long; record ids are made from name (or the key)."""
    name = str(key) if name is None else name
    base = _fields(key, uri, hashlib.sha1(payload).hexdigest())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts):
        seg = [] if len(parts) == 1 else [("WARC-Segment-Number", str(k + 1))]
        if k:
            seg.append(("WARC-Segment-Origin-ID", _urn(f"{name}/0")))
        if k and k == len(parts) - 1:
            seg.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record([("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", _urn(f"{name}/{k}")), *base, *seg], part)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError("a record's header is cut short")
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(2) != CRLF:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def write(pages: DataFrame, scratch: Scratch, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 1000, segment: int = 16 << 10, archive_bytes: int = 64 << 20, few: int = 50_000) -> str:
    """Write one response or revisit for each row; returns the folder of gzipped archives.

    Of rows whose payloads are equal and have at least ``least`` bytes, that with the
    largest key is the response, the others revisit it. Equality is decided on the
    SHA-1 and length alone: one aggregation of (digest, key), combined map-side, and
    joins of narrow rows. As long as at most ``few`` rows are revisits, they are broadcast
    and the payloads are read once more, where they lie. Beyond that, two bitmaps of
    BITS bits each tell which rows have copies and which of those may be responses: rows
    without copies stay where they are, revisits are joined without their payloads, and
    only possible responses that have copies are shuffled whole.
    A null payload is empty; null keys never become a revisit's target or a revisit;
    repeated keys with one payload stay one response and are written each; an empty
    table writes no record. Each written row has a record id of its own, from its task
    and place there; a response that is revisited has one from its key and digest, so
    that WARC-Refers-To can name it. Where several rows could be that response (its key
    and payload are repeated), revisits give its key only. An archive holds about
    archive_bytes of records at most.
    """
    spark = pages.sparkSession
    ship(spark)
    src = pages.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("n", F.length("payload"))
    shared = (F.col("n") >= least) & F.col("key").isNotNull()
    narrow = scratch.table(src.select("key", F.when(shared, F.sha1("payload")).alias("digest"), "n"), "digests")
    size = narrow.agg(F.avg("n")).first()[0] or 0
    times = narrow.filter("digest is not null").groupBy("digest", "n", "key").agg(F.count("*").alias("times"))
    heads = times.groupBy("digest", "n").agg(F.max(F.struct("key", "times")).alias("head"), F.sum("times").alias("all")).filter("all > 1")
    heads = heads.select("digest", "n", F.col("head.key").alias("refers_to"), (F.col("head.times") == 1).alias("alone"))
    revisits = scratch.table(times.join(heads, ["digest", "n"]).filter("key <> refers_to or alone").select("key", "digest", "n", "refers_to", "alone"), "revisits")
    fields = ["key", "uri", "payload", "digest", "refers_to", "alone", "n"]
    hashed = src.withColumn("digest", F.when(shared, F.sha1("payload")))
    if revisits.count() <= few:
        # keys may be repeated with other payloads: the digest joins too
        dealt = hashed.join(F.broadcast(revisits), ["key", "digest", "n"], "left").select(fields)
    else:
        heads = scratch.table(heads, "heads")
        copied = _bitmap(spark, heads.select(_slot("digest")), "digest")
        pairs = times.filter(copied).join(heads, ["digest", "n"], "left").filter("refers_to is null or refers_to = key")
        first = _bitmap(spark, pairs.select(_slot("key", "digest")), "key", "digest")
        none = lambda df: df.withColumn("refers_to", F.lit(None).cast("long")).withColumn("alone", F.lit(None).cast("boolean"))
        plain = none(hashed.filter(F.col("digest").isNull() | ~copied)).select(fields)
        marked = hashed.filter(F.col("digest").isNotNull() & copied)
        again = marked.filter(~first).select("key", "uri", "digest", "n").join(heads, ["digest", "n"]).withColumn("payload", F.lit(None).cast("binary")).select(fields)
        dealt = plain.unionByName(again).unionByName(marked.filter(first).join(revisits, ["key", "digest", "n"], "left").select(fields))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            for key, uri, payload, digest, refers_to, alone, n in zip(*(b.column(i).to_pylist() for i in range(7))):
                target = f"{refers_to}/{digest}" if alone else None
                name, count = f"{key}/{task}/{count}", count + 1
                if refers_to is not None and refers_to == key:
                    name, refers_to, target = target, None, None
                uri = uri.replace("\r", "").replace("\n", "")
                made = records(key, uri, payload, segment, name) if refers_to is None else [revisit(key, uri, digest, n, refers_to, name, target)]
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary())], names=["record"])

    path = f"{scratch.path}/archives"
    most = max(1, int(archive_bytes // min(segment + 500, size + 500)))
    dealt.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def _slot(*columns: str) -> Column:
    """Numbers from 1 to BITS."""
    return (F.pmod(F.xxhash64(*columns), F.lit(BITS)) + 1).alias("slot")


def _bitmap(spark: SparkSession, slots: DataFrame, *columns: str) -> Column:
    """True for every row whose slot of these columns is among slots, and for few others: BITS bits, whatever the input's size."""
    found = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found.toLocalIterator():
        at = (r["part"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(slot: pa.Array) -> pa.Array:
        i = slot.to_numpy(zero_copy_only=False).astype(np.int64) - 1
        return pa.array((shared.value[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(run, "boolean")(_slot(*columns))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(key, uri, record_type, refers_to, payload_bytes, payload_digest, payload) of every response and revisit.

    A revisit has no payload of its own; its length and digest are those it was stored
    with. Payloads are decoded, measured and hashed in any case; payloads=False leaves
    them out of the result.
    """
    ship(spark)
    schema = "origin string, number int, total long, key long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, block binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(data.as_buffer()))):
                    kind, number = f["warc-type"], int(f.get("warc-segment-number", 0))
                    to = f.get("x-refers-to-key")
                    key = int(f["x-key"]) if f.get("x-key") else None
                    if kind == "revisit":
                        rows.append((None, 0, None, key, f["warc-target-uri"], kind, int(to), int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), None))
                    elif not number:
                        payload = payload_of(block)
                        rows.append((None, 0, None, key, f["warc-target-uri"], kind, None, len(payload), hashlib.sha1(payload).hexdigest(), payload if payloads else None))
                    else:
                        total = f.get("warc-segment-total-length")
                        rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number, int(total) if total else None, key, f["warc-target-uri"], "response", None, None, f["warc-payload-digest"].removeprefix("sha1:"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.warc import reassemble

        for b in batches:
            out = [[], [], [], [], []]
            for key, uri, segments in zip(*(b.column(i).to_pylist() for i in range(3))):
                payload = reassemble([(s["number"], s["total"], s["block"]) for s in segments])
                for c, v in zip(out, (key, uri, len(payload), payload if payloads else None, hashlib.sha1(payload).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()))], names=["key", "uri", "payload_bytes", "payload", "payload_digest"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, schema)
    whole = rows.filter("origin is null").select("key", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", F.col("block").alias("payload"))
    cut = rows.filter("origin is not null").groupBy("origin").agg(F.first("key").alias("key"), F.first("uri").alias("uri"), F.collect_list(F.struct("number", "total", "block")).alias("segments"))
    joined = cut.select("key", "uri", "segments").mapInArrow(join, "key long, uri string, payload_bytes long, payload binary, payload_digest string")
    joined = joined.select("key", "uri", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "payload")
    return whole.unionByName(joined)


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The payload of (number, total length if last, block) segments in any order; repeats of a segment count once."""
    by = {n: (t, b) for n, t, b in segments}
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError(f"segments {sorted(by)} are not gapless")
    block = b"".join(by[n][1] for n in sorted(by))
    if by[len(by)][0] != len(block):
        raise ValueError(f"segments have {len(block)} bytes, the total length is {by[len(by)][0]}")
    return payload_of(block)
