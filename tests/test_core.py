"""Functions and driver-side helpers without an oracle query, against plain Python."""

import io as _io
import json
import logging
import math
import os
import random
import re
import zipfile
from collections import Counter
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import providers, runs, scorers
from corpusmill.functions import text as T
from corpusmill.functions.text import stem
from corpusmill.operators import losses, ngrams, rerank, selection, stats
from corpusmill.sources import io
from corpusmill.streaming import jobs


def column(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("v")).first().v


def texts(n, seed=1, words="the cat's runs running happily over old stones . And ! it is".split()):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(n)]


# -- text metrics ------------------------------------------------------------------
def test_stems():
    pairs = "ponies poni|cats cat|feed feed|agreed agre|plastered plaster|motoring motor|sing sing|conflated conflat|sized size|falling fall|failing fail|filing file|sky sky|conditional condit|rational ration|digitizer digit|operator oper|hopefulness hope|triplicate triplic|formative form|electrical electr|revival reviv|allowance allow|adoption adopt|probate probat|rate rate|cease ceas|controll control|roll roll"
    assert all(stem(a) == b for a, b in (p.split() for p in pairs.split("|")))


def brute_rouge(target, prediction):
    def toks(x):
        return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (x or "").lower())]

    def f(hit, a, b):
        if not hit:
            return 0.0
        p, r = hit / a, hit / b
        return 2 * p * r / (p + r)

    a, b, out = toks(target), toks(prediction), []
    for n in (1, 2):
        x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
        out.append(f(sum(min(x[g], y[g]) for g in x), sum(y.values()), sum(x.values())))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
    return [*out, f(table[-1][-1], len(b), len(a))]


def test_rouge(spark):
    rows = list(zip(texts(60), texts(60, 2))) + [("", ""), (None, "a"), ("same words here", "same words here")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.rouge(F.col("a"), F.col("b")).alias("r")).select("r.*").collect()
    for (a, b), r in zip(rows, got):
        assert all(abs(x - y) < 1e-9 for x, y in zip(r, brute_rouge(a, b)))


def test_copy_parts(spark):
    import difflib

    rows = list(zip(texts(60, 3), texts(60, 4))) + [("A b", "a  B"), ("", "x"), (None, "x"), ("x", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(T.copy_parts(F.col("a"), F.col("b")).alias("p")).select("p.*").collect()
    for (a, b), r in zip(rows, got):
        if a is None or b is None:
            assert set(r) == {None}
            continue
        x, y = (" ".join(s.lower().split()) for s in (a, b))
        s, c = re.findall("[a-z']+", x), re.findall("[a-z']+", y)
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        overlap = sum(w in s for w in c) / len(c) if s and c else 0.0
        short, best = min(len(s), len(c), 4), 0
        for n in range(2, short + 1):
            if {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} & {tuple(c[i : i + n]) for i in range(len(c) - n + 1)}:
                best = n
        shared = best / short if short > 1 else 0.0
        want = [float(x == y), ratio, overlap, shared, 1.5 * (x == y) + 0.5 * ratio + 0.3 * overlap + 0.2 * shared]
        assert all(abs(u - v) < 1e-9 for u, v in zip(r, want))


def test_failure_report(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.2), round(rng.random(), 3), round(rng.random() / 2, 3)) for _ in range(101)]
    got = rerank.failure_report(spark.createDataFrame(rows, "exact_copy double, sequence_similarity double, repeat_fraction double")).first()
    e, s, r = zip(*rows)
    mean = lambda v: round(sum(v) / len(v), 6)
    assert got.n_examples == 101 and got.median_similarity == sorted(s)[50]
    assert math.isclose(got.exact_copy_rate, mean(e)) and math.isclose(got.near_copy_rate, mean([x >= 0.9 for x in s])) and math.isclose(got.avg_similarity, mean(s))
    assert math.isclose(got.avg_repeat, mean(r)) and math.isclose(got.high_repeat_rate, mean([x >= 0.35 for x in r]))


def test_ngrams_at_a_lower_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").select("doc_id", "text")
    count, of = Counter(), {}
    for r in docs.collect():
        w = re.findall("[a-z']+", r.text.lower())
        of[r.doc_id] = {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
        count.update(of[r.doc_id])
    want = {g: n for g, n in count.items() if n >= 8}
    assert want
    grams = ngrams.overused(docs, "text", 8)
    assert {r.gram: r.n for r in grams.collect()} == want
    for few in (500_000, 0):
        got = ngrams.hits(docs, "doc_id", "text", grams, few=few)
        assert Counter((r.doc_id, r.gram) for r in got.collect()) == Counter((i, g) for i, s in of.items() for g in s if g in want)
    for r in ngrams.repetition(docs, "doc_id", "text", grams).collect():
        p = sum(math.log1p(want[g]) for g in of[r.doc_id] if g in want)
        assert abs(r.repetition_penalty - p) < 1e-5 and abs(r.weight - 1 / (1 + p)) < 1e-5


def test_quantiles_and_pairs(spark):
    rng = random.Random(8)
    for values in ([], [3.0], [1.0, 2.0], [round(rng.gauss(0, 1), 1) for _ in range(501)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = stats.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0])
        s = sorted(values)
        for p, x in zip([0.0, 0.25, 0.5, 0.9, 1.0], got):
            k = p * (len(s) - 1)
            assert x is None if not s else abs(x - (s[int(k)] + (s[min(int(k) + 1, len(s) - 1)] - s[int(k)]) * (k - int(k)))) < 1e-9
    rows = [(1, i, float(i % 3), f"t{i}") for i in range(5)] + [(2, 0, 1.0, "only")]
    df = spark.createDataFrame(rows, "g long, at int, score double, txt string")
    got = {(r.chosen_pos, r.rejected_pos) for r in rerank.all_pairs(df, ["g"], "score", "at", "txt", 0.5).collect()}
    assert got == {(a, b) for _, a, x, _ in rows[:5] for _, b, y, _ in rows[:5] if x - y >= 0.5}
    with pytest.raises(Exception, match="over 4 candidates"):
        rerank.all_pairs(df, ["g"], "score", "at", "txt", 0.5, most=4).collect()


def test_candidates(spark):
    assert column(spark, scorers.dedupe_candidates(F.col("x")), x=["b", "A ", "B", "", " a", "c"]) == ["b", "A ", "c"]
    assert column(spark, scorers.first_distinct(F.col("x"), 2), x=["b", "a", "b", "c"]) == ["b", "a"]


# -- selection, splits, order --------------------------------------------------------
def test_thresholds_positions_and_splits(spark):
    df = spark.createDataFrame([(1, 0.2), (2, None), (3, 0.9)], "k long, v double")
    assert selection.at_least(df, "v", 0.0).count() == 3 and [r.k for r in selection.at_least(df, "v", 0.5).collect()] == [3]
    keys = random.Random(6).sample(range(-(10**6), 10**8), 500)
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    assert {r.k: r.pos for r in selection.positions(d, "k", width=16).collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert sorted(r.k for r in selection.drop_first(d, "k", 490).collect()) == sorted(keys)[490:]
    assert selection.drop_first(d, "k", 1000).count() == 0
    f = jobs.flushes(d, "k", 6)
    assert f.columns == ["k", "flush"] and Counter(Counter(r.flush for r in f.collect()).values()) == {6: 83, 2: 1}
    parts = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(60)], "k long, split string")
    got = selection.combine_splits(parts, "k").collect()
    for s in ("train", "test"):
        order = [r.k for r in sorted((r for r in got if r["split"] == s), key=lambda r: r.position)]
        assert sorted(order) == sorted(r.k for r in got if r["split"] == s) != order


def test_early_stop_and_budget(spark):
    metrics = [1.0, 3.0, 2.0, 4.0, 4.0, 3.0, 9.0]
    df = spark.createDataFrame([(0, i, m) for i, m in enumerate(metrics)] + [(1, 0, 5.0)], "run long, step long, m double")
    got = losses.early_stop(df, ["run"], ["step"], "m").orderBy("run", "step").collect()
    assert [(r.run, r.step, r.is_best) for r in got] == [(0, 0, True), (0, 1, True), (0, 2, False), (0, 3, True), (0, 4, False), (0, 5, False), (1, 0, True)]
    ids = column(spark, losses.clamp_ids(losses.argmax_ids(F.col("x")), 0, 2), x=[[0.1, 0.9, 0.3], [float("nan"), 0.2, 0.7], [0.5, 0.5, 0.1]])
    assert ids == [1, 1, 0]
    assert column(spark, losses.clamp_ids(F.col("x"), 7, 100), x=[1.0, float("nan"), None, -2.0, 500.0]) == [1.0, 7.0, 7.0, 7.0, 99.0]


def test_correlations(spark):
    rng = random.Random(7)
    rows = [(float(i), i + rng.gauss(0, 20)) for i in range(60)] + [(None, 1.0)]
    got = stats.correlations(spark.createDataFrame(rows, "a double, b double"), "a", "b")
    x, y = zip(*rows[:-1])
    rank = lambda v: [sorted(v).index(u) for u in v]
    def r(u, v):
        a, b = sum(u) / len(u), sum(v) / len(v)
        return sum((i - a) * (j - b) for i, j in zip(u, v)) / math.sqrt(sum((i - a) ** 2 for i in u) * sum((j - b) ** 2 for j in v))

    assert got["n"] == 60 and abs(got["pearson"] - r(x, y)) < 1e-9 and abs(got["spearman"] - r(rank(x), rank(y))) < 1e-6
    assert 0 < got["pearson_p"] < 0.01 and 0 < got["spearman_p"] < 0.01
    many = spark.createDataFrame([(round(rng.gauss(0, 1), 2),) for _ in range(2000)], "v double")
    ranks = {r.v: r.q for r in stats.average_ranks(many, "v", "q", ranges=7).collect()}
    values = sorted(r.v for r in many.collect())
    assert all(q == (values.index(v) + len(values) - values[::-1].index(v) + 1) / 2 for v, q in ranks.items())


# -- providers -----------------------------------------------------------------------
def test_calls_wait_and_give_up():
    waits, answers = [], [RuntimeError("429: please retry in 7 s"), RuntimeError("503"), RuntimeError("UNAVAILABLE"), [["a"], ["b"]]]

    def provider(batch):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert providers.call(provider, ["x", "y"], sleep=waits.append) == ([["a"], ["b"]], None) and waits == [12, 30, 45]
    answers[:] = [ValueError("bad json"), [["only one"]], ValueError("bad again")]
    waits.clear()
    got, error = providers.call(provider, ["x", "y"], sleep=waits.append)
    assert got == [[], []] and "bad again" in error and waits == [5, 10]
    answers[:] = [RuntimeError("429")] * 3
    assert providers.call(provider, ["x"], sleep=waits.append, patience=2)[1] == "RuntimeError: 429"


def fussy(batch):
    if "poison" in batch:
        raise ValueError("no answer")
    return [[t, t.upper(), t + "!", ""] for t in batch]


def test_generate_and_pick(spark):
    rows = [(i, t) for i, t in enumerate(["plain words", "poison", None, "more words here"] * 5)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    made = providers.generate(df, "text", fussy, batch=1, sleep=lambda s: None).collect()
    assert [r.error is None for r in made] == [t != "poison" for _, t in rows] and all(r.candidates == [] for r in made if r.text == "poison")
    assert all(len(r.candidates) == 4 for r in made if r.error is None)
    whole = providers.generate(df, "text", fussy, batch=6, sleep=lambda s: None)
    assert [r.id for r in whole.filter("error is null").collect()] == [18, 19] and whole.count() == 20  # the last, partial batch
    best, none = providers.pick_and_emit(df, "id", "text", fussy, batch=1, sleep=lambda s: None)
    assert {r.id for r in none.collect()} == {i for i, t in rows if t == "poison"}
    assert {(r.text, r.candidate) for r in best.collect()} == {("plain words", "plain words!"), ("more words here", "more words here!"), ("", "!")}


# -- runs, sources, sinks --------------------------------------------------------------
def test_run_arithmetic(spark):
    assert column(spark, runs.duration(F.col("x")), x=360_061) == "100:01:01"
    assert column(spark, runs.time_left(F.col("x"), F.lit(4), F.lit(10)), x=8.0) == 12.0 and column(spark, runs.time_left(F.col("x"), F.lit(0), F.lit(10)), x=8.0) is None
    assert column(spark, F.array(runs.backoff(F.col("x")), runs.failure_wait(F.col("x")), runs.warmup_steps(F.col("x"), 0.3)), x=9) == [120, 45, 2]


def test_logger():
    out, log = _io.StringIO(), runs.logger("corpusmill.test", run="a")
    handler = logging.StreamHandler(out)
    log.logger.addHandler(handler)
    log.info("batch done", extra={}, fields={"rows": 3})
    log.logger.removeHandler(handler)
    assert out.getvalue() == "batch done run=a rows=3\n"


def test_readers(spark, tmp_path):
    p = str(tmp_path / "rows")
    os.mkdir(p)
    (tmp_path / "rows" / "a.jsonl").write_text('\n{"a":"x","b":1}\n{"a":"y"}\n')
    rows, _ = io.read_jsonl(spark, p, "a string, b long", "skip", ["a"], {"b": 7})
    assert sorted(map(tuple, rows.collect())) == [("x", 1), ("y", 7)]
    with pytest.raises(Exception):
        io.read_jsonl(spark, p, "a string, b long", "fail", ["b"])[0].collect()
    (tmp_path / "array.json").write_text('[\n {"a": "x",\n  "b": 1},\n {"a": "y"}\n]')
    assert sorted(map(tuple, io.read_json_array(spark, str(tmp_path / "array.json"), "a string, b long").collect()), key=str) == [("x", 1), ("y", None)]
    (tmp_path / "t.csv").write_text('n,v,s,e\n1,2.5,"a ""b""\nc",\n2,NA,nan,\n,3,x,\n')
    got = io.read_csv(spark, str(tmp_path / "t.csv"), na=io.NA_TEXTS, infer=True)
    assert [t for _, t in got.dtypes][:3] == ["bigint", "double", "string"] and sorted(map(tuple, got.select("n", "v", "s").collect()), key=str) == [(1, 2.5, 'a "b"\nc'), (2, None, None), (None, 3.0, "x")]
    assert {t for _, t in io.read_csv(spark, str(tmp_path / "t.csv")).dtypes} == {"string"}
    assert io.processed_keys(spark, str(tmp_path / "absent"), "k").count() == 0
    assert sorted(r.a for r in io.processed_keys(spark, p, "a").collect()) == ["x", "y"]
    assert io.require_path(spark, p) == p
    with pytest.raises(FileNotFoundError):
        io.require_path(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="missing columns: z"):
        io.require_columns(rows, ["a", "z"])
    (tmp_path / "c.yaml").write_text("model: {type: bart}\ntraining: {output_dir: out}\ndata: {source_prefix: 'do: '}\n")
    assert io.config_row(io.load_config(str(tmp_path / "c.yaml"))) == {"type": "bart", "output_dir": "out", "source_prefix": "do: "}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\U0001f600", 0.5), (2, 'q "x"\ny', None)], "k long, t string, s double")
    io.write_json_document(df, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())[0] == {"k": 1, "t": "é😀", "s": 0.5}
    with pytest.raises(ValueError):
        io.write_json_document(df, str(tmp_path / "d.json"), limit=1)
    io.write_csv(df, str(tmp_path / "csv"), ["t", "k"])
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "csv")).collect())) == [('q "x"\ny', "2"), ("é😀", "1")]
    io.write_jsonl(df, str(tmp_path / "ascii"), ascii_only=True)
    raw = "".join(p.read_text() for p in (tmp_path / "ascii").glob("part-*"))
    assert raw.isascii() and sorted(json.loads(x)["t"] for x in raw.splitlines()) == sorted(["é😀", 'q "x"\ny'])
    assert io.write_best(df, "s", str(tmp_path / "best.json"), "k")["k"] == 1 == json.loads((tmp_path / "best.json").read_text())["k"]
    io.write_xlsx(df, str(tmp_path / "x.xlsx"))
    z, ns = zipfile.ZipFile(tmp_path / "x.xlsx"), {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    assert [c.get("width") for c in sheet.findall(".//m:col", ns)] == ["5", "11", "7"] and len(sheet.findall(".//m:row[@ht='15']", ns)) == 3
    assert ["".join(c.itertext()) for c in sheet.findall(".//m:c", ns)] == ["k", "t", "s", "1", "é😀", "0.5", "2", 'q "x"\ny', ""]
    with pytest.raises(ValueError):
        io.write_xlsx(df, str(tmp_path / "x.xlsx"), limit=1)


def test_run_helpers(spark, tmp_path):
    assert io.run_dir("out", "a") == "out_a" and io.run_dir("out") == "out" and re.fullmatch(r"out_\d{8}_\d{6}", io.run_dir("out", auto_suffix=True))
    assert io.output_name("runs/bart/checkpoint-20", ".csv") == "bart.csv" and io.output_name("runs/bart", ".csv") == "bart.csv"
    assert io.format_table([{"m": "sft", "v": 0.5}], ["m", "v"]) == "m    v\nsft  0.5000"
    assert io.report({"style_accuracy": 0.25, "n": 3}, [("a b", 2)]).splitlines()[1:] == [f"{'N':<28}: 3", "       2  a b"]
    with pytest.raises(ValueError):
        io.check_pairs_request(True, 1)
    io.check_pairs_request(False, 1)
    assert io.baseline_matrix({}) == ["sft", "sft_rerank", "dpo", "dpo_rerank"] and io.baseline_matrix({"sft": False, "have_sft": True, "dpo": False}) == ["sft_rerank"]
    assert {tuple(r) for r in io.ablation_grid(spark, ["a", "b"], ["v", "w", "c"]).collect()} == {(x, y) for x in "ab" for y in "vwc"}
    calls = []
    with pytest.raises(FileNotFoundError):
        io.require_model(str(tmp_path / "m"))
    assert io.require_model(str(tmp_path / "m"), calls.append) == str(tmp_path / "m") == calls[0]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "weights").write_text("x")
    assert io.require_model(str(tmp_path / "m")) == calls.pop() and not calls
