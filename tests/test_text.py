from pyspark.sql import functions as F

from corpusmill.functions import jsonrepair, scorers
from corpusmill.functions import text as T
from corpusmill.functions.text import stem
from corpusmill.operators import selection, stats
from corpusmill.sources import io


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("v")).first().v


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize(F.col("x")), x="  Big \t News \n") == "big news"
    assert one(spark, T.tokens(F.col("x")), x="Mayor's 2 Dogs, re-elected") == ["mayor's", "dogs", "re", "elected"]
    assert one(spark, T.ngram_set(T.tokens(F.col("x")), (2, 3)), x="a b c a b") == ["a b", "b c", "c a", "a b c", "b c a", "c a b"]
    assert one(spark, T.ngram_set(T.tokens(F.col("x")), (2, 3)), x="rain") == []
    assert one(spark, T.fold_ascii(F.col("x")), x="…–ß") == "...-ss"


def test_repeat_and_template(spark):
    assert abs(one(spark, T.max_repeat_fraction(T.tokens(F.col("x"))), x="go go stop") - 2 / 3) < 1e-12
    assert one(spark, T.max_repeat_fraction(T.tokens(F.col("x"))), x="12345") == 0.0
    assert one(spark, T.opening_template(T.tokens(F.col("x"))), x="12345") == ""


def test_copy_penalty(spark):
    rows = [("A b c", "a  B c"), ("", ""), ("tide", "diet"), ("diet", "tide")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.copy_parts(F.col("a"), F.col("b")).alias("p")).select("p.*").collect()
    assert abs(got[0].copy_penalty - 2.5) < 1e-9 and abs(got[1].copy_penalty - 2.0) < 1e-9
    assert (got[2].sequence_similarity, got[3].sequence_similarity) == (0.25, 0.5)


def test_stem():
    assert [stem(w) for w in ("caresses", "hopping", "relational", "happy", "adjustment")] == ["caress", "hop", "relat", "happi", "adjust"]


def test_json_repair(spark):
    assert len(one(spark, jsonrepair.salvage(F.col("x"), "struct<a:string>"), x='[{"a":"x"},{"a":"y"},{"a":"z')) == 2
    assert one(spark, jsonrepair.headlines(F.col("x")), x='```json\n{"headlines":["H1"," "]}\n```') == ["H1"]
    assert one(spark, jsonrepair.retry_delay(F.col("x")), x="Please Retry in 42s") == 47
    assert one(spark, jsonrepair.retry_delay(F.col("x")), x="no number") == 65


def test_candidate_dedupe(spark):
    assert one(spark, scorers.dedupe_candidates(F.col("x")), x=["X y", "x  Y", "", " Z"]) == ["X y", " Z"]
    assert one(spark, scorers.dedupe_candidates(F.col("x")), x=["", " "]) == [""]


def test_argmax_rescale_split(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, float("nan")), ("b", 1, None), (None, 1, 9.0)], "k string, p int, s double")
    assert [tuple(r) for r in selection.argmax(df, ["k"], "s", "p").collect()] == [("a", 1, 1.0)]
    v = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "x double")
    assert sorted(r.x for r in selection.rescale(v, "x").collect()) == [0, 1, 2]
    assert [r.x for r in selection.rescale(spark.createDataFrame([(3.0,)] * 3, "x double"), "x").collect()] == [None] * 3
    s = selection.split(spark.range(10272), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 8217, "val": 1027, "test": 1028}
    s = selection.split(spark.range(11), "id", rule="ceil").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 8, "val": 1, "test": 2}
    assert selection.split(spark.range(0), "id").count() == 0


def test_p_value():
    assert abs(stats.correlation_p_value(0.5, 20) - 0.0248) < 5e-4


def test_readers_and_helpers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"h":"a","s":1.5}\n\nbad{\n{"s":2.0}\n')
    rows, rejects = io.read_jsonl(spark, str(tmp_path), "h string, s double", "report", ["h"], {"s": 0.0})
    assert [tuple(r) for r in rows.collect()] == [("a", 1.5)] and rejects.count() == 2
    assert io.output_name("runs/bart/final", ".csv") == "bart.csv" and io.prompt_prefix(None, "my/t5-base", "do: ") == "do: "
    assert io.parse_list("1, 2,,3", int) == [1, 2, 3]
    assert io.RunSettings.from_env({"CANDIDATES": "4"}).candidates == 4
    assert io.baseline_matrix({"sft": False}) == []
