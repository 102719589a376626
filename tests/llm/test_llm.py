"""The ten operators against brute force, round trips and library results, with the awkward inputs."""

import gzip
import hashlib
import html.parser
import io as _io
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import boilerplate, bpe, covertree, decontaminate, langid, ngram_lm, simhash, tokenfile, toxicity, warc
from corpusmill.llm.components import components
from corpusmill.runtime import Scratch

EDGE = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (4, "a b c d " * 500, "x"), (4, "a b c d " * 500, "x"), (None, "null id text", "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, fp string")  # fp clashes with an operator's own column


def union_find(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 400)]
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(5), Scratch(spark, "t")).distinct().collect())
    want = union_find(401, links)
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [1 << 16, 2])
def test_simhash_groups(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    low = union_find(len(rows), links)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[low[i]] = min(smallest.get(low[i], r.doc_id), r.doc_id)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_groups(docs, bucket=bucket).collect()}
    assert got == {r.doc_id: (fps[i], smallest[low[i]]) for i, r in enumerate(rows)}


def test_covering_masks_catch_every_pair():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        masks = [m for m, _ in simhash.covering_masks(list(range(64)), radius)]
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


def test_covering_masks_of_radius_6_key_enough():
    rng = random.Random(9)
    masks = simhash.covering_masks(list(range(64)), 6)
    assert min(m.bit_count() for m, _ in masks) >= 32
    assert all(len(free) <= 32 for _, free in masks)
    assert min(finer.bit_count() for m, free in masks if free for finer, _ in simhash.covering_masks(free, 6)) >= 8
    for positions, covering in ((list(range(64)), masks), (masks[5][1], simhash.covering_masks(masks[5][1], 6))):
        for _ in range(500):
            diff = sum(1 << b for b in rng.sample(positions, 6))
            assert any(not diff & m for m, _ in covering)


def test_simhash_splits_buckets_of_radius_6(spark):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(base) for _ in range(50)) for _ in range(100)]
    fps = [fingerprint(t) for t in texts]
    low = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs, radius=6, bucket=16).collect()}
    assert got == dict(enumerate(low))


def test_simhash_edge(spark, edge):
    got = simhash.near_duplicate_groups(edge).collect()
    assert len(got) == len(EDGE) and {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicate_groups(edge.limit(0)).count() == 0


def test_bpe_equals_library():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec, want = bpe.Codec(ranks, P.PATTERN, leaf=24, piece_leaf=8), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "th", "ing", "'", "s", "'re", " ", "  ", "\n", "\t", "1", "22", ".", "!!", "é", "ß", "漢", "😀", "　", "\xa0", "\x1c", " the", "don't"]
    for i in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 160)))
        s = s.replace(" ", "").replace("\n", "") if i % 3 == 0 else s
        ids = codec.encode(s)
        assert ids == want.encode_ordinary(s) and codec.decode(ids) == s.encode()


def test_bpe_long_runs():
    """Long texts, with and without seams, at the leaf size in use; windows grow through a run that has none."""
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec, want = bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(18)
    texts = ["a" * 5000, "ab" * 3000, "the" * 4000, "=" * 9000, "é" * 3000, " " * 5000, "\n" * 3000 + "x", "".join(rng.choice("abcdefgh") for _ in range(20_000)), " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 12))) for _ in range(5000)), "a b" + "c" * 3000 + " d" * 2000]
    for t in texts:
        ids = codec.encode(t)
        assert ids == want.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_documents(spark, edge):
    got = bpe.encode_documents(edge, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(EDGE)
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in EDGE}
    assert bpe.encode_documents(edge.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def library_rows(docs):
    """(doc_id, n_tokens, ids_crc32) of each document by the tokenizers library alone."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


def token_rows(spark, docs, **settings):
    s = Scratch(spark, "t")
    path, dictionary = tokenfile.write_token_files(docs, P.path("byte_bpe_50k.json"), scratch=s, **settings)
    return tokenfile.positions(tokenfile.read_token_files(spark, path, dictionary), s).orderBy("start").collect()


SPECIAL = [(90_000_000, "hello <|endoftext|> world"), (90_000_001, "<|endoftext|>"), (90_000_002, "tab\there \x1cand\xa0there's  two\n\nlines. "), (90_000_003, "'tis the dogs' 're' \"quoted\"..., 'll"), (-(1 << 63), "smallest id")]


def test_token_files(spark, edge, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame(SPECIAL, "doc_id long, text string")).withColumn("frame", F.lit("clash")).withColumn("shard", F.lit(1))
    got = token_rows(spark, docs, shard_bytes=50_000)
    want = sorted(library_rows((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _, _ in want]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert token_rows(spark, docs.limit(0)) == []
    blob = tokenfile.pack([(5, 2, tokenfile.compressor(b"").compress(np.array([7, 0], "<u4").tobytes()))], b"")
    assert tokenfile.read_one(blob + b"\n", 5, b"") == [7, 0] and tokenfile.read_one(blob, 6, b"") is None


def test_token_files_spread_a_hot_id(spark):
    rows = [(i, f"text {i} of many") for i in range(100)] + [(50, "the same text again and again")] * 300 + [(None, f"no id {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = Scratch(spark, "t")
    path, dictionary = tokenfile.write_token_files(docs, P.path("byte_bpe_50k.json"), scratch=s, shard_bytes=1000)
    read = tokenfile.read_token_files(spark, path, dictionary)
    assert read.filter("doc_id = 50").groupBy("file").count().agg(F.count("*"), F.max("count")).first()[0] > 2
    got = tokenfile.positions(read, s).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(library_rows(rows))
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_token_chunks_equal_whole():
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    enc, tok = tokenfile.ChunkEncoder(definition, keep=500), Tokenizer.from_str(definition)
    rng = random.Random(4)
    parts = ["a", "th", "ing", "'", "'re", " ", "  ", "\n", "\t", "1", ".", ",", "!!", "?", "é", "漢", "😀", "\xa0", " the", "don't", "x.", " 's", "\x1c", "\x85", "ŉ", "_", "a\u0301", "ⁿ", "***", "<|endoftext|>"]
    for k in range(120):
        texts = ["".join(rng.choice(parts[: -(k % 2) or None]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
        for t, raw in zip(texts, enc.raws(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def brute_links(v, cosine):
    x = np.array(v, float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = x @ x.T >= cosine
    np.fill_diagonal(m, False)
    return m


@pytest.mark.parametrize("cell,kind", [(2048, "float"), (40, "float"), (40, "double"), (20, "int")])
def test_cover_tree(spark, cell, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 8)), np.repeat(base[:1], 20, 0), base[:3] + 0.1 * rng.normal(size=(3, 8)), rng.normal(size=(80, 8))]).astype(np.float32)
    if kind == "int":
        v = (v * 1000).astype(np.int32)
    rows = [(i, v[i].tolist(), i % 2) for i in range(len(v))] + [(1000, None, 0), (1001, (0 * v[0]).tolist(), 0), (1002, v[0].tolist()[:-1] + [None], 0), (1003, v[0].tolist(), None)]
    if kind != "int":
        rows[-2] = (1002, [float("nan")] + [1.0] * 7, 0)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("cell", F.lit("clash")).withColumn("v", F.lit(0))
    got = {r.vec_id: r for r in covertree.links(df, cosine=0.95, cell=cell, pivots=4).collect()}
    assert len(got) == len(rows)
    for label in (0, 1):
        ids = [i for i in range(len(v)) if i % 2 == label]
        m = brute_links(v[ids], 0.95)
        low = union_find(len(ids), list(zip(*np.nonzero(m))))
        for k, i in enumerate(ids):
            assert got[i].n_links == m[k].sum() and got[i].component_id == ids[low[k]] and got[i].kept == (ids[low[k]] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1004))


def test_cover_tree_edge(spark):
    rng = np.random.default_rng(16)
    a, b = rng.normal(size=6), rng.normal(size=6)
    rows = [(1, a.tolist(), "x"), (1, (2 * a).tolist(), "x"), (1, b.tolist(), "x"), (2, a.tolist(), "x"), (2, a.tolist(), "x"), (3, a[:5].tolist(), "x"), (4, a[:5].tolist(), "x"), (5, a.tolist(), "y"), (None, a.tolist(), "x"), (6, [], "x"), (7, (b * 1e-3).tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for cell in (8192, 2):
        got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.links(df, cell=cell, pivots=2).collect())
        assert got == {(1, 3, 1, True): 2, (1, 1, 1, True): 1, (2, 3, 1, False): 2, (3, 1, 3, True): 1, (4, 1, 3, False): 1, (5, 0, 5, True): 1, (None, 0, None, False): 1, (6, 0, 6, True): 1, (7, 1, 1, False): 1}
    assert covertree.links(df.limit(0)).count() == 0


def test_cover_tree_parts_cells(spark):
    """Clusters far apart: cells meet their neighbours only, and centres lie in different clusters."""
    rng = np.random.default_rng(17)
    base = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    v = np.concatenate([base[i] + 0.01 * rng.normal(size=(40, 16)) for i in range(16)])
    assert sorted(i // 40 for i in covertree.centers(v / np.linalg.norm(v, axis=1)[:, None], 16)) == list(range(16))
    x = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = covertree.dual_links(x, tree := covertree.build(x, np.arange(len(x)), leaf=4), tree, 0.98)
    want = np.triu(x @ x.T >= 0.98, 1)
    assert len(i) == want.sum() and want[np.minimum(i, j), np.maximum(i, j)].all()
    df = spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = covertree.links(df, cell=100).collect()
    m = x @ x.T >= 0.98
    assert all(r.n_links == m[r.vec_id].sum() - 1 and r.component_id == r.vec_id // 40 * 40 for r in got)


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 40_000
    rows = [(1, "u1", "a" * 1000), (2, "u2", "a" * 1000), (3, "u3", "a" * 999), (4, "u4", "a" * 999), (5, None, None), (6, "u\r\n6", big), (7, "u7", "WARC/1.1\r\n\r\n" * 200), (8, "u8", ""), (None, "u9", "a" * 1000)]
    s = Scratch(spark, "t")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.key: r for r in warc.read(spark, warc.write(pages, s, segment=4096)).collect()}
    assert len(got) == len(rows) and got[1].record_type == "revisit" and got[1].refers_to == 2 and got[3].record_type == "response"
    for k, _, h in rows:
        assert got[k].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() and got[k].payload_bytes == len((h or "").encode())
        if got[k].record_type == "response":
            assert bytes(got[k].payload) == (h or "").encode()


@pytest.mark.parametrize("few", [50_000, 0])
def test_warc_repeated_and_null_keys(spark, few):
    a, b, c = "a" * 40_000, "b" * 40_000, "c" * 40_000
    rows = [(1, "u1", a)] * 3 + [(1, "other", a), (1, "u1", b), (2, "u2", c), (3, "u3", c), (4, "u4", a)] + [(None, f"n{i % 4}", a) for i in range(6)] + [(5, "u5", b + b), (5, "u5", b + b), (2, "u6", b + b)]
    s = Scratch(spark, "t")
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("digest", F.lit("clash")), s, segment=4096, archive_bytes=100_000, few=few)
    got = warc.read(spark, path).collect()
    bare = warc.read(spark, path, payloads=False).collect()
    assert sorted(map(str, (r[:6] for r in got))) == sorted(map(str, (r[:6] for r in bare))) and {r.payload for r in bare} == {None}
    assert Counter((r.key, r.uri, r.payload_digest) for r in got) == Counter((k, u, hashlib.sha1(h.encode()).hexdigest()) for k, u, h in rows)
    assert Counter((r.key, r.refers_to) for r in got if r.record_type == "revisit") == {(1, 4): 4, (2, 3): 1, (2, 5): 1}
    assert all(bytes(r.payload) in (a.encode(), b.encode(), c.encode(), (b + b).encode()) for r in got if r.record_type == "response")
    fields = [f for x in spark.read.format("binaryFile").load(path).collect() for f, _ in warc.parse(gzip.GzipFile(fileobj=_io.BytesIO(x.content)))]
    ids = Counter(f["warc-record-id"] for f in fields)
    assert max(ids.values()) == 1
    heads = {f["warc-record-id"]: f["x-key"] for f in fields if f["warc-type"] == "response"}
    assert all(heads[f["warc-refers-to"]] == f["x-refers-to-key"] for f in fields if "warc-refers-to" in f)
    assert Counter(f["x-refers-to-key"] for f in fields if "warc-refers-to" in f) == {"4": 4, "3": 1}


def test_warc_empty_and_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert warc.read(spark, warc.write(pages.limit(0), Scratch(spark, "t"))).count() == 0
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for i, h in rows:
        last[h] = max(i, last.get(h, i))
    want = {i: (len(h), hashlib.sha1(h).hexdigest(), "response" if len(h) < 1000 or last[h] == i else "revisit", None if len(h) < 1000 or last[h] == i else last[h]) for i, h in rows}
    for few in (50_000, 0):
        got = warc.read(spark, warc.write(pages, Scratch(spark, "t"), few=few), payloads=False).collect()
        assert {r.key: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)


def test_warc_frames():
    data = bytes(range(256)) * 50
    parts = [(f["warc-segment-number"] if "warc-segment-number" in f else None, f.get("warc-segment-total-length"), b) for f, b in warc.parse(_io.BytesIO(b"".join(r + b"\r\n" for r in warc.records(1, "u", data, 1000))))]
    segments = [(int(n), int(t) if t else None, b) for n, t, b in parts]
    random.Random(1).shuffle(segments)
    assert warc.reassemble(segments) == data
    with pytest.raises(ValueError):
        warc.reassemble([x for x in segments if x[0] != 3])
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_main_text():
    page = '<html><body class="has-sidebar"><nav><a href=x>Home</a></nav><div class="ad">Buy the best of it</div><article><h1>Title of the day</h1><p>' + "The cat and the dog went to the house of the man. " * 5 + "&amp; more<br>next</p><p>Short.</p><section id='comments'><p>I like the way of it.</p></section></article><footer>&copy; us</footer><script>var a='</p>';</script>"
    assert boilerplate.main_text(page) == "Title of the day\n\n" + "The cat and the dog went to the house of the man. " * 5 + "& more next\n\nShort."
    assert boilerplate.main_text(None) == "" and boilerplate.main_text("<p") == "" and boilerplate.main_text("<nav><a>x</a>") == ""


PROSE = "The cat and the dog went to the house of the man. " * 6


def test_main_text_weighs_names():
    for names in ("content has-sidebar", "page no-comments", "news alert", "content sidebar-left", "main-content with-related", "sidebar"):
        assert boilerplate.main_text(f'<body><div class="{names}"><p>{PROSE}</p></div></body>') == PROSE.strip()
    page = f'<div class="post"><p>{PROSE}</p><p>Short.</p></div><div class="%s"><p>{PROSE * 4}</p></div>'
    for names in ("comments", "comment-list", "sidebar", "cookie-banner", "ad"):
        assert boilerplate.main_text(page % names) == PROSE.strip() + "\n\nShort."
    assert boilerplate.main_text(page.replace("PROSE * 4", "") % "alert").startswith(PROSE.strip())


def test_main_text_of_other_scripts_and_broken_tags():
    chinese = "这是一个关于城市历史的文章，它讲述了人们如何在河边建立家园并且发展贸易。" * 4
    assert boilerplate.main_text(f"<nav>菜单</nav><div><p>{chinese}</p></div>") == chinese
    assert boilerplate.main_text(f'<div><p>{PROSE}</p></div><div><p>{chinese}</p></div><div class="ad">{PROSE}</div>') == PROSE.strip() + "\n\n" + chinese
    assert boilerplate.main_text(f'<p title="x>{PROSE}</p><p class="y">{PROSE}</p>') == PROSE.strip() + "\n\n" + PROSE.strip()
    assert boilerplate.main_text(f"<p title='a > b' data-x=\"<i>\">{PROSE}</p>") == PROSE.strip()


def test_main_text_is_linear():
    pages = ["<p>ab</p>" * 100_000, "<a " * 100_000, '<a "' * 50_000, "<div>" * 50_000 + "</ul>" * 50_000 + "x", "<" * 100_000, "<!--" * 20_000, "<script>" * 20_000, '<div class="ad">a' * 30_000]
    start = time.process_time()
    for p in pages:
        boilerplate.main_text(p)
    assert time.process_time() - start < 40


class Article(html.parser.HTMLParser):
    """Text blocks of the article element, as the generated pages hold it."""

    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_main_text_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in boilerplate.extract(pages).collect()}
    for r in pages.collect():
        want = Article()
        want.feed(r.html or "")
        text = "\n\n".join(x for x in (" ".join(b.split()) for b in want.blocks) if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_main_text_edge(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, f"<p>{PROSE}</p>"), (2, None, f"<p>{PROSE}</p>"), (None, "n", f"<article>x</article>"), (3, "l", f"<p>{PROSE * 20_000}</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("h", F.lit(1))
    got = boilerplate.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.url, r.n_chars) for r in got.collect()) == Counter([(1, "u", 0), (1, "u", 0), (2, None, 299), (2, None, 299), (None, "n", 1), (3, "l", 300 * 20_000 - 1)])
    assert boilerplate.extract(pages.limit(0)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(20)]
    docs = [(i, text(300)) for i in range(40)]
    for i in range(10):
        w = items[i][1].split()
        if i % 2:
            w[5], w[15], w[25] = "other", "words", "here"
        docs.append((100 + i, text(100) + " " + " ".join(w).upper() + ", " + text(50)))
    docs += [(200, None), (201, ""), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(100 + i, i) for i in range(10)} | {(None, 0)}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontaminate_edge(spark):
    rng = random.Random(14)
    text = lambda n: " ".join(f"x{rng.randrange(500)}" for _ in range(n))
    one, two, three = text(25), text(25), text(25)
    items = spark.createDataFrame([(1, one), (1, two), (None, three), (2, "lone"), (3, None)], "item_id long, text string").withColumn("score", F.lit(1))
    docs = [(5, text(50) + " " + one), (5, text(50) + " " + one), (6, two), (7, "x " * 200_000 + three), (None, "a lone word"), (8, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    for block in (8 << 20, 10):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_bytes=block).collect())
        assert got == {(5, 1): 2, (6, 1): 1, (7, None): 1, (None, 2): 1}
        kept = docs.filter(~decontaminate.holds_item(F.col("text"), decontaminate.seeds(docs, items, block_bytes=block)))
        assert [r.doc_id for r in kept.collect()] == [8] and kept.columns == docs.columns


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 20)
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def toxic_rows(n=120, seed=11):
    """Texts of 30 words out of 40, toxic ones with a telling word or two; half of the rows each."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{min(int(rng.expovariate(0.1)), 39)}" for _ in range(30)]
        if i % 2:
            w[3:5] = ["you", rng.choice(["fool", "scum"])]
        elif i % 3 == 0:
            w[7] = "you"
        out.append((" ".join(w), i % 2))
    return out


class BruteKneserNey:
    """The formulas of the module's docstring over dictionaries."""

    def __init__(self, rows, discount=0.75, z=4.0):
        n = Counter(y for _, y in rows)
        self.v = len({w for t, _ in rows for w in t.split()})
        grams = lambda t: [(t.split(),), (list(zip(t.split(), t.split()[1:])),)]
        c, df = [[Counter(), Counter()] for _ in range(2)], [[Counter(), Counter()] for _ in range(2)]
        for t, y in rows:
            for k, (g,) in enumerate(grams(t)):
                c[k][y].update(g)
                df[k][y].update(set(g))

        def kept(k, y, g):
            a, b = df[k][0][g], df[k][1][g]
            p = (a + b) / len(rows)
            error = math.sqrt(p * max(1 - p, 1e-9) * (1 / n[0] + 1 / n[1]))
            return max(c[k][y][g] - discount, 0) if abs(b / n[1] - a / n[0]) >= z * error and a + b >= 4 else 0

        self.c = c
        self.kept = [[{g: kept(k, y, g) for g in {*c[k][0], *c[k][1]}} for y in (0, 1)] for k in (0, 1)]
        self.follows = Counter(w for _, w in {*c[1][0], *c[1][1]})
        self.contexts = len({*c[1][0], *c[1][1]})

    def p(self, y, h, w):
        n, kept = sum(self.c[0][y].values()), self.kept[0][y]
        one = (kept.get(w, 0) + (n - sum(kept.values())) * (self.follows[w] + 1) / (self.contexts + self.v + 1)) / n
        after = {g: k for g, k in self.c[1][y].items() if g[0] == h}
        total = sum(after.values())
        if not total:
            return one
        kept = self.kept[1][y]
        return (kept.get((h, w), 0) + (total - sum(kept[g] for g in after)) * one) / total


def test_toxicity_models_are_kneser_ney():
    rows = toxic_rows()
    sample = toxicity.Sample(rows)
    model = toxicity.KneserNey(sample, np.ones(len(sample.coded), bool), 0.75, 4.0)
    brute = BruteKneserNey(rows)
    number = {w.decode(): i for i, w in enumerate(sample.names)}
    assert {"fool", "scum"} <= {w for w, i in number.items() if model.telling[i]} and model.telling_pairs.any() and not model.telling.all()
    every = np.arange(-1, len(number))
    for c in (0, 1):
        for h in every:
            p = model.bigram(c, np.full(len(every), h), every)
            assert abs(p.sum() - 1) < 1e-9
            if h % 5 == 0 or h < 0:
                word = sample.names[h].decode() if h >= 0 else "unseen"
                assert all(abs(p[i + 1] - brute.p(c, word, w)) < 1e-12 for w, i in number.items())
    scorer = toxicity.ToxicityModel()
    code = scorer._lay_out(model)
    for text, _ in [*toxic_rows(20, 12), ("unseen you fool unseen scum you scum", 1)]:
        w = text.split()
        want = [math.log(brute.p(1, h, x) / brute.p(0, h, x)) for h, x in zip(["unseen", *w], w)]
        assert np.allclose(scorer.differences(scorer.coder.codes(text)), want)
        at = np.array([number.get(x, -1) for x in w])
        assert np.allclose(model.log_likelihood(1, at) - model.log_likelihood(0, at), want)
    assert (code[[number["fool"], number["scum"]]] > 0).all()


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxicity.fit(docs, labels.filter(fold != 2))
    got = toxicity.score(docs.filter(fold == 2), model).join(labels, "doc_id").select("predicted", "toxic").collect()
    n = Counter((r.predicted, r.toxic) for r in got)
    assert n[1, 1] / (n[1, 1] + n[0, 1]) > 0.91 and n[0, 0] / (n[0, 0] + n[1, 0]) > 0.98
    assert model.score(None) < 0.3 and model.score("") < 0.3
    assert toxicity.ToxicityModel().fit([], 0.0).score("text") < 0.3


def test_toxicity_edge(spark, edge):
    rows = [(i, t, "x") for i, (t, _) in enumerate(toxic_rows())]
    docs = spark.createDataFrame([*rows, *rows[:3], (5, "another text of id 5", "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(toxic_rows())] + [(0, 0), (1, 1), (7, None), (999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    same = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert model.weights.tolist() == same.weights.tolist() and model.coder.ids == same.coder.ids
    long = "w1 w2 w3 " * 300_000
    extra = spark.createDataFrame([(4, long, "x"), (5, long + "you fool " * 30, "x")], "doc_id long, text string, score string")
    got = toxicity.score(edge.select("doc_id", "text", F.lit("clash").alias("score")).unionByName(extra), model)
    assert got.columns == ["doc_id", "score", "predicted"]
    by = sorted((r.doc_id or 0, r.score) for r in got.collect())
    assert len(by) == len(EDGE) + 2 and all(0 <= s <= 1 for _, s in by)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels.limit(0))).filter("predicted = 1").count() == 0
    few = toxicity.fit(docs, labels, max_docs=20)
    assert few.score("you fool") >= 0


def test_language_held_out(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.filter(fold != 0), max_docs=100)
    got = langid.predict(docs.filter(fold == 0), model).join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !") == ("und", 0.0)
    assert langid.predict(edge, model).count() == len(EDGE)


def test_language_edge(spark, edge):
    rows = [(i, t, lang, "x") for lang, parts in (("aa", "ka ti lo mu"), ("bb", "sch zung ein ver"), ("cc", "ção ões lha")) for i, t in enumerate([" ".join(random.Random(i).choices(parts.split(), k=40)) for i in range(60)])]
    docs = spark.createDataFrame([*rows, *rows[:50], (1, None, "aa", "x"), (2, "", "bb", "x"), (None, "no id", "aa", "x"), (3, "no language", None, "x")], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, max_docs=40)
    assert model.languages == ["aa", "bb", "cc"] and np.array_equal(model.weights, langid.fit(docs.repartition(5), max_docs=40).weights)
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == docs.count() and got.filter("lang_pred = 'und'").count() == 2
    assert model.predict("sch zung " * 500_000)[0] == "bb"
    empty = langid.fit(docs.limit(0))
    assert langid.predict(docs, empty).filter("lang_pred <> 'und'").count() == 0 and langid.predict(docs.limit(0), model).count() == 0


def test_language_model_is_ftrl():
    """Weights against one-coordinate-at-a-time follow-the-regularised-leader; the temperature against a grid."""
    rng = np.random.default_rng(13)
    rows = []
    for k in range(60):
        lang = "abc"[k % 3]
        at = np.unique(np.concatenate([rng.integers(0, 64, 6), rng.integers(20 * (k % 3), 20 * (k % 3) + 20, 4)]))
        rows.append((at, rng.integers(1, 5, len(at)).astype(float), lang, int(rng.integers(0, 1 << 40))))
    m = langid.LanguageModel(buckets=64, epochs=2).fit(rows)
    rows.sort(key=lambda r: r[3])
    df = Counter(b for at, *_ in rows for b in at.tolist())
    idf = {b: math.log(61 / (1 + n)) + 1 for b, n in df.items()}
    vectors = []
    for at, counts, lang, h in rows:
        v = {b: (1 + math.log(n)) * idf[b] for b, n in zip(at.tolist(), counts.tolist())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append(({b: x / norm for b, x in v.items()}, "abc".index(lang), h % 5 == 0))
    z, n = Counter(), Counter()

    def weight(key):
        if abs(z[key]) <= m.l1:
            return 0.0
        return -(z[key] - math.copysign(m.l1, z[key])) / ((m.beta + math.sqrt(n[key])) / m.alpha + m.l2)

    def softmax(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    for _ in range(2):
        for v, y, held in vectors:
            if held:
                continue
            x = {**v, "bias": 1.0}
            w = {(b, c): weight((b, c)) for b in x for c in range(3)}
            p = softmax([sum(x[b] * w[b, c] for b in x) for c in range(3)])
            for b in x:
                for c in range(3):
                    g = x[b] * (p[c] - (c == y))
                    z[b, c] += g - (math.sqrt(n[b, c] + g * g) - math.sqrt(n[b, c])) / m.alpha * w[b, c]
                    n[b, c] += g * g
    for b in range(64):
        assert np.allclose(m.weights[b], [weight((b, c)) for c in range(3)], atol=1e-6)
    assert np.allclose(m.bias, [weight(("bias", c)) for c in range(3)]) and (m.weights == 0).any()
    scores = [([sum(x * m.weights[b][c] for b, x in v.items()) + m.bias[c] for c in range(3)], y) for v, y, held in vectors if held]
    loss = lambda t: -sum(math.log(softmax([x / t for x in s])[y]) for s, y in scores)
    assert loss(m.temperature) <= min(loss(math.exp(k / 50)) for k in range(-140, 141)) + 1e-6


def test_elias_fano():
    rng = np.random.default_rng(8)
    for n, bits in ((0, 30), (1, 64), (3000, 64), (3000, 20), (20000, 50)):
        keys = np.unique(rng.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64))
        e, _ = ngram_lm.EliasFano.load(b"".join(ngram_lm.EliasFano.encode(keys, bits).dump()), 0)
        ask = np.concatenate([keys, rng.integers(0, 2 ** min(bits, 63), 1000, dtype=np.uint64)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert e.find(ask).tolist() == [at.get(int(k), -1) for k in ask]


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    train = docs.filter("doc_id % 3 <> 0")
    folder, n = ngram_lm.train(train, Scratch(spark, "t"), shard_bytes=40_000)
    got = {r.doc_id: r for r in ngram_lm.score(docs, folder, n).collect()}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c, pairs = Counter(), Counter()
    for r in train.collect():
        c.update(words(r.text))
        pairs.update(zip([b"^", *words(r.text)], words(r.text)))
    total, types = sum(c.values()), len(c)
    for r in docs.collect():
        w = words(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_known, got[r.doc_id].train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert abs(got[r.doc_id].base_score - sum(math.log10((c[x] + 1) / (total + types + 1)) for x in w)) < 1e-6 * len(w)
    held = [r.doc_id for r in docs.collect() if r.doc_id % 3 == 0]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_language_model_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    train = docs.filter("doc_id % 3 <> 0")
    folder, n = ngram_lm.train(train, Scratch(spark, "t"), shard_bytes=1 << 40)
    assert n == 1
    words = lambda t: [b"^", *(t or "").encode().lower().split(), None]
    c = [Counter(), Counter(), Counter()]
    for r in train.collect():
        w = words(r.text)
        for k in range(3):
            c[k].update(zip(*(w[i:] for i in range(k + 1))))
    unigrams = Counter({k: v for k, v in c[0].items() if k != (b"^",)})
    total, types = sum(unigrams.values()), len(unigrams)
    below, successors, d = [Counter(), Counter()], [Counter(), Counter()], []
    for k in (1, 2):
        n1, n2 = (sum(v == x for v in c[k].values()) for x in (1, 2))
        d.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))))
        for g, v in c[k].items():
            below[k - 1][g[:-1]] += v
            successors[k - 1][g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (unigrams[g] + 1) / (total + types + 1)
        k, h = len(g) - 2, g[:-1]
        if not below[k][h]:
            return p(g[1:])
        return (max(c[k + 1][g] - d[k], 0) + d[k] * successors[k][h] * p(g[1:])) / below[k][h]

    got = {r.doc_id: r for r in ngram_lm.score(docs, folder, n).collect()}
    for r in docs.collect():
        w = words(r.text)
        want = [math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(1, len(w))]
        assert abs(got[r.doc_id].score - sum(want)) < 0.02 * len(want)


def test_language_model_keeps_every_ngram(spark):
    texts = ["a b c", " A  b\td\n", "x a b c", None]
    block = ngram_lm.Block(texts)
    shards = 3
    assert len(block.left) == 9 and len(block.before) == 7
    kept = [0, 0]
    for s, blob in ngram_lm._requests(block, shards):
        words, pairs, counts = ngram_lm._merge([blob, blob])
        kept[0] += len(words[2])
        kept[1] += len(pairs[2])
        assert (words[3] % 2 == 0).all() and (pairs[3] % 2 == 0).all() and (counts % 2 == 0).all()
    assert kept == [9, 7]


def test_pipeline_drops_what_the_operator_calls_toxic(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert any(0.3 <= x < 0.4 for x in scores.values())
    kept = {r.doc_id for r in corpus_pipeline.keep_civil(spark, docs, folder).select("doc_id").collect()}
    assert kept == {i for i, x in scores.items() if x < 0.3}


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (None, c), (None, c), (None, c + " end"), (3, d), (None, d), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()]
    fps = {t: fingerprint(t) for t in (b, b + " end", c, c + " end")}
    assert (fps[b] ^ fps[b + " end"]).bit_count() <= 6 and (fps[c] ^ fps[c + " end"]).bit_count() <= 6
    assert len(got) == 5 and {(1, a), (1, b), (3, d), (4, None)} <= set(got)
    assert [t in (c, c + " end") for i, t in got if i is None] == [True]


def brute_groups(rows, radius=6):
    """Rows kept of (doc_id, text) rows: the first of each group of linked fingerprints, by id (null last)."""
    fps = [fingerprint(t) for _, t in rows]
    low = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(low[k], []).append((i is None, i or 0))
    return Counter(min(v) for v in best.values())


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on all that the one before kept, judged row by row in plain Python."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(900001, None, None, None, 0), (900002, "", "en", "s", 0), (None, "no id but words of its own here", "en", "s", 30), (900003, "12 345 !!", None, "s", 9)]
    extra = spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(5)).withColumn("score", F.lit(1.5)).withColumn("fp", F.lit("x")).withColumn("h", F.lit(2))
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = Scratch(spark, "t").table(stage(spark, docs, sf), name)
        if name == "bpe":
            enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            assert Counter((r.doc_id, bytes(r.ids)) for r in out.collect()) == Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
            continue
        assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "simhash":
            assert Counter((i is None, i or 0) for i, _ in got.elements()) == brute_groups(rows) and not got - Counter(rows)
        else:
            if name == "toxicity":
                model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
                keep = lambda t: model.score(t) < corpus_pipeline.TOXIC  # noqa: E731, B023
            elif name == "language":
                lm = langid.fit(docs)
                keep = lambda t: lm.predict(t)[0] != "und" and lm.predict(t)[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE  # noqa: E731, B023
            else:
                items = [decontaminate.words(t) for _, t in benchmark if decontaminate.words(t)]
                held = lambda w, x: decontaminate.align(np.array(x), np.array(w))[0] >= len(x) if set(w) & set(x) else False
                keep = lambda t: not any(held(decontaminate.words(t), x) for x in items)  # noqa: E731, B023
            assert got == Counter((i, t) for i, t in rows if keep(t))
        docs = out
    assert docs.count() > 50


def test_pipeline_run(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 50


def test_language_model_blocks():
    rng = random.Random(15)
    parts = ["a", "Word", "é", "\xa0", "漢字", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "x" * 70, "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "   ", "y" * 200_000]
    block = ngram_lm.Block(texts)
    low = {k: v for k, v in zip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")}
    words = [bytes(low.get(c, c) for c in (t or "").encode()).split() for t in texts]
    assert block.sizes.tolist() == [len(w) + 1 for w in words]
    code, at = {}, 0
    for w in words:
        got = block.tokens[at : at + len(w) + 1].tolist()
        assert got[-1] == 0 and all(code.setdefault(x, c) == c for x, c in zip(w, got))
        assert block.context[at : at + len(w) + 1].tolist() == [1, *got[:-1]]
        at += len(w) + 1
    assert len(set(code.values())) == len(code) == len(block.hash) - 2 == len(set(block.hash.tolist())) - 2
    again = ngram_lm.Block(texts[::-1][:150])
    of = dict(zip((x for w in words for x in w), (block.hash[code[x]] for w in words for x in w)))
    at = 0
    for w in words[::-1][:150]:
        assert all(again.hash[again.tokens[at + k]] == of[x] for k, x in enumerate(w))
        at += len(w) + 1


def test_language_model_edge(spark, edge):
    docs = edge.withColumn("score", F.lit(1)).unionByName(spark.createDataFrame([(9, "a b c d e " * 100_000, "x", 1)], "doc_id long, text string, fp string, score int"))
    folder, n = ngram_lm.train(docs, Scratch(spark, "t"), shard_bytes=200)
    got = ngram_lm.score(docs, folder, n, block_bytes=1000)
    assert got.count() == len(EDGE) + 1 and got.filter("score > 0 or score is null or base_score > 0").count() == 0
    by = Counter((r.doc_id, r.n_tokens, r.n_known) for r in got.collect())
    assert by[4, 2001, 2001] == 2 and by[9, 500_001, 500_001] == 1 and by[1, 1, 1] == by[2, 1, 1] == 1
    assert ngram_lm.score(docs.limit(0), folder, n).count() == 0
    none, k = ngram_lm.train(docs.limit(0), Scratch(spark, "t"))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in ngram_lm.score(edge, none, k).collect()} == {(0, 0, 0.0)}
