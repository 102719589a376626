"""Registered queries over the standard tables, each with the SQL of its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions import jsonrepair, providers, runs, scorers
from corpusmill.functions import text as T
from corpusmill.operators import losses, ngrams, rerank, selection, stats
from corpusmill.runtime import Scratch, ship
from corpusmill.sources import io
from corpusmill.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6)


# Shared SQL pieces -----------------------------------------------------------
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQUEEZE = rf"regexp_replace(regexp_replace(%s, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"
TOKENS = "regexp_extract_all(lower(%s), '[a-z'']+')"
U = "(('0x' || substr(md5('%s|' || %s), 1, 13))::UBIGINT / 4503599627370496.0)"
WIN = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, conf FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, l_linenumber) rn FROM (SELECT l.*, round((l_extendedprice-mc)/sc*0.6 + (l_quantity-ms)/ss*0.4, 6) conf FROM lineitem l, (SELECT avg(l_extendedprice) mc, stddev_samp(l_extendedprice) sc, avg(l_quantity) ms, stddev_samp(l_quantity) ss FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL) WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)) WHERE rn = 1"
PAIRS = "SELECT u.conv_id, u.turn, u.text AS src, a.text AS cand FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"
EN = "(SELECT doc_id, text, source FROM documents WHERE lang = 'en')"
NG = f"(SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(t)-1), lambda i: t[i] || ' ' || t[i+1]) || list_transform(generate_series(1, len(t)-2), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) gram FROM (SELECT doc_id, {TOKENS % 'text'} t FROM {EN})))"
SCORED = "SELECT l_orderkey, l_linenumber::BIGINT*10000000 + l_partkey AS l_linenumber, l_shipdate::VARCHAR AS txt, l_discount*10 AS style, l_tax*10 AS similarity, l_quantity/50 AS copy, l_extendedprice AS perplexity, round(2.0*(l_discount*10) + 1.0*(l_tax*10) - 1.5*(l_quantity/50) - 0.15*ln(greatest(l_extendedprice, 1e-8)), 6) AS score FROM lineitem"


def pairs_of_turns(spark, d) -> DataFrame:
    c = t(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    return u.join(a, ["conv_id", "turn"])


def scored(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem")
    s = li.select("l_orderkey", (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("txt"), (F.col("l_discount") * 10).alias("style"), (F.col("l_tax") * 10).alias("similarity"), (F.col("l_quantity") / 50).alias("copy"), F.col("l_extendedprice").alias("perplexity"))
    return s.withColumn("score", r6(rerank.linear_score(F.col("style"), F.col("similarity"), F.col("copy"), F.col("perplexity"))))


def english(spark, d) -> DataFrame:
    return t(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text", "source")


def winners(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    z = selection.zscores(li.na.drop(subset=["l_extendedprice", "l_quantity"]), ["l_extendedprice", "l_quantity"])
    z = z.withColumn("conf", r6(F.col("l_extendedprice_norm") * 0.6 + F.col("l_quantity_norm") * 0.4)).drop("l_extendedprice_norm", "l_quantity_norm")
    return selection.argmax(z, ["l_orderkey"], "conf", "l_linenumber")


# Selection -------------------------------------------------------------------
@query(f"WITH w AS ({WIN}) SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, round((conf-mn)/nullif(av-mn,0), 6) AS confidence FROM w, (SELECT min(conf) mn, avg(conf) av FROM w)")
def candidate_select(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return selection.select_candidates(li, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "confidence")


@query(f"WITH w AS ({WIN}), r AS (SELECT l_orderkey, l_quantity, round((conf-mn)/nullif(av-mn,0), 6) c FROM w, (SELECT min(conf) mn, avg(conf) av FROM w)), x AS (SELECT * FROM r WHERE l_quantity > 25) SELECT l_orderkey, round((c-mn)/nullif(av-mn,0), 5) AS confidence FROM x, (SELECT min(c) mn, avg(c) av FROM x)")
def confidence_rescale(spark, d):
    c = selection.rescale(winners(spark, d), "conf", 6).filter("l_quantity > 25")
    return selection.rescale(c, "conf", 5).select("l_orderkey", F.col("conf").alias("confidence"))


@query("WITH z AS (SELECT l_orderkey, l_linenumber, (l_extendedprice-mc)/sc zc, (l_quantity-ms)/ss zs FROM lineitem, (SELECT avg(l_extendedprice) mc, stddev_samp(l_extendedprice) sc, avg(l_quantity) ms, stddev_samp(l_quantity) ss FROM lineitem)), g AS (SELECT a/10.0 alpha, l_orderkey, max(round(zs*(a/10.0) + zc*(1-a/10.0), 6)) v FROM z, range(0, 11) r(a) GROUP BY ALL), m AS (SELECT alpha, avg(v) mu FROM g GROUP BY alpha) SELECT format('a={:.1f}', g.alpha) AS label, round(avg(v), 6) AS mean, round(avg((v-mu)^3)/power(avg((v-mu)^2), 1.5), 4) AS skew, round(avg((v-mu)^4)/power(avg((v-mu)^2), 2) - 3, 4) AS kurt FROM g JOIN m USING (alpha) GROUP BY g.alpha")
def alpha_sweep_moments(spark, d):
    z = selection.zscores(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])
    alphas = [i / 10 for i in range(11)]
    # one aggregation with a column for each alpha: rows are not multiplied before the shuffle
    best = z.groupBy("l_orderkey").agg(*[r6(F.max(F.col("l_quantity_norm") * a + F.col("l_extendedprice_norm") * (1 - a))).alias(f"v{i}") for i, a in enumerate(alphas)])
    g = best.select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"v{i}").alias("v")) for i, a in enumerate(alphas)])).alias("x")).select("x.*")
    return g.groupBy("alpha").agg(r6(F.avg("v")).alias("mean"), F.round(F.skewness("v"), 4).alias("skew"), F.round(F.kurtosis("v"), 4).alias("kurt")).select(F.format_string("a=%.1f", "alpha").alias("label"), "mean", "skew", "kurt")


@query("SELECT l_orderkey, l_linenumber, k AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['discount','quantity','tax']) k, unnest([l_discount, CASE WHEN l_quantity > 10 THEN l_quantity END, l_tax]) v FROM lineitem) WHERE v IS NOT NULL")
def unpivot_metrics(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "quantity", "tax"], "measure", "value").filter("value is not null")


@query("SELECT l_orderkey, count(*)::BIGINT AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS nested FROM lineitem GROUP BY l_orderkey")
def nest_candidates(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return g.select("l_orderkey", F.size("c").cast("long").alias("n"), F.array_join(F.transform("c", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"])), ",").alias("nested"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::BIGINT - 1 AS pos, l_partkey, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) // 2)::BIGINT AS chunk FROM lineitem")
def flatten_scored(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return g.select("l_orderkey", F.posexplode("c").alias("pos", "x")).select("l_orderkey", F.col("pos").cast("long").alias("pos"), "x.l_partkey", F.floor(F.col("pos") / 2).alias("chunk"))


@query("SELECT o_orderkey, coalesce(o_orderpriority, '') AS reference, coalesce(n, 0)::BIGINT AS candidates FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON o_orderkey = l_orderkey")
def empty_group_survives(spark, d):
    c = t(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("c"))
    return t(spark, d, "orders").join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("reference"), F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("candidates")).withColumn("candidates", F.greatest("candidates", F.lit(0).cast("long")))


@query("SELECT l_orderkey, l_linenumber, s AS score FROM (SELECT l_orderkey, l_linenumber, round((l_discount + l_tax)/2, 4) s, row_number() OVER (PARTITION BY l_orderkey ORDER BY round((l_discount + l_tax)/2, 4) DESC, l_linenumber) rn FROM lineitem WHERE l_linenumber <= 5) WHERE rn = 1")
def candidate_pick_raw_mean(spark, d):
    c = t(spark, d, "lineitem").filter("l_linenumber <= 5").select("l_orderkey", "l_linenumber", F.round((F.col("l_discount") + F.col("l_tax")) / 2, 4).alias("score"))
    return selection.argmax(c, ["l_orderkey"], "score", "l_linenumber")


@query("SELECT l_orderkey, max(l_extendedprice) AS best, arg_max(l_linenumber, l_extendedprice*100 - l_linenumber*0.001)::INT AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def candidate_pick_max(spark, d):
    return selection.argmax(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("best")), ["l_orderkey"], "best", "l_linenumber")


# Filters, projections, unions ------------------------------------------------
@query("SELECT l.doc_id, l.toxic FROM labels l WHERE toxic = 1")
def label_filter(spark, d):
    return t(spark, d, "labels").filter("toxic = 1").select("doc_id", "toxic")


@query("SELECT CASE toxic WHEN 0 THEN 'Factual' WHEN 1 THEN 'Satirical' END AS label_text, count(*) AS n FROM labels GROUP BY 1")
def class_distribution(spark, d):
    lab = F.create_map(F.lit(0), F.lit("Factual"), F.lit(1), F.lit("Satirical"))
    return t(spark, d, "labels").withColumn("label_text", F.try_element_at(lab, F.col("toxic"))).groupBy("label_text").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE {SQUEEZE % 'text'} <> '' AND source IS NOT NULL AND lang IS NOT NULL")
def nonempty_filter(spark, d):
    return t(spark, d, "documents").na.drop(subset=["source", "lang"]).filter(T.strip(F.col("text")) != "").select("doc_id")


@query("SELECT doc_id, quality FROM labels WHERE NOT (coalesce(quality, 0.0) < 0.5 OR coalesce(toxic, 0.0) < 0.0)")
def threshold_filter(spark, d):
    q, x = F.coalesce(F.col("quality"), F.lit(0.0)), F.coalesce(F.col("toxic"), F.lit(0.0))
    return t(spark, d, "labels").filter((q >= 0.5) & (x >= 0.0)).select("doc_id", "quality")


@query("SELECT doc_id, 'any' AS minimum FROM labels UNION ALL SELECT doc_id, 'half' FROM labels WHERE quality >= 0.5")
def conditional_threshold(spark, d):
    lab = t(spark, d, "labels").select("doc_id", "quality")
    a, b = (selection.at_least(lab, "quality", m).select("doc_id", F.lit(n).alias("minimum")) for m, n in ((0.0, "any"), (0.5, "half")))
    return a.unionByName(b)


@query("SELECT doc_id, lang FROM documents")
def drop_passthrough(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "n_chars").drop("n_chars")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity/50 > 0.5")
def strict_truncation(spark, d):
    return t(spark, d, "lineitem").filter("l_quantity/50 > 0.5").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, d):
    return selection.remaining(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels"), "doc_id")


@query("SELECT a.doc_id, b.doc_id AS winner_id FROM documents a JOIN (SELECT doc_id, lang, source, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) b ON a.n_chars IS NOT DISTINCT FROM b.n_chars AND a.source IS NOT DISTINCT FROM b.source")
def synthetic_inner_merge(spark, d):
    docs = t(spark, d, "documents")
    b = docs.join(t(spark, d, "labels").filter("quality = 1"), "doc_id").select(F.col("doc_id").alias("winner_id"), F.col("n_chars").alias("_n"), F.col("source").alias("_s"))
    return docs.join(b, F.col("n_chars").eqNullSafe(F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "winner_id")


@query("SELECT a.doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b JOIN labels l ON b.doc_id = l.doc_id AND l.quality = 1 WHERE a.n_chars IS NOT DISTINCT FROM b.n_chars AND a.source IS NOT DISTINCT FROM b.source)")
def real_anti_split(spark, d):
    docs = t(spark, d, "documents")
    return selection.null_safe_semi(docs, docs.join(t(spark, d, "labels").filter("quality = 1"), "doc_id"), ["n_chars", "source"], "left_anti").select("doc_id")


@query("SELECT count(*) - (SELECT count(*) FROM labels WHERE quality = 1) AS left_rows, min(doc_id) AS first_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) rn FROM documents) WHERE rn > 0 GROUP BY ALL")
def real_positional_split(spark, d):
    """The literal form: drop as many leading rows as there are winners; here only their number is reported."""
    k = t(spark, d, "labels").filter("quality = 1").agg(F.count("*").alias("k"))
    return selection.with_one_row(t(spark, d, "documents").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), k).select((F.col("n") - F.col("k")).alias("left_rows"), "first_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) rn FROM documents) WHERE rn > (SELECT count(*) FROM labels WHERE quality = 1)")
def positional_rest(spark, d):
    """The literal form: as many leading rows go as there are winners."""
    k = t(spark, d, "labels").filter("quality = 1").count()
    return selection.drop_first(t(spark, d, "documents").select("doc_id"), "doc_id", k)


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality > 0.5 AND l.toxic < 0.5")
def good_slice(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").filter("quality > 0.5 and toxic < 0.5"), "doc_id").select("doc_id")


@query(f"SELECT conv_id, turn, src AS factual, cand AS satirical, 'forward' AS source FROM ({PAIRS}) UNION ALL SELECT conv_id, turn, cand, src, 'backward' FROM ({PAIRS})")
def role_swap_union(spark, d):
    p = pairs_of_turns(spark, d)
    a = p.withColumnsRenamed({"src": "factual", "cand": "satirical"}).withColumn("source", F.lit("forward"))
    b = p.withColumnsRenamed({"src": "satirical", "cand": "factual"}).withColumn("source", F.lit("backward"))
    return a.unionByName(b)


@query("SELECT doc_id, 'a' AS tag, coalesce(quality, 0)::INT AS value FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 'b', coalesce(toxic, 1)::INT FROM labels WHERE toxic = 1")
def provenance_union(spark, d):
    lab = t(spark, d, "labels")
    a = lab.filter("toxic = 0").select("doc_id", F.lit("a").alias("tag"), F.coalesce("quality", F.lit(0)).alias("value"))
    b = lab.filter("toxic = 1").select(F.lit("b").alias("tag"), F.coalesce("toxic", F.lit(1)).alias("value"), "doc_id")
    return a.unionByName(b)


@query("SELECT doc_id, 'style: ' || coalesce(nullif(source, ''), 'none') || ' ' || lang AS prompt, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ''), source) AS chosen, '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' AS message FROM documents")
def prompt_templates(spark, d):
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("style: "), F.coalesce(F.nullif("source", F.lit("")), F.lit("none")), F.lit(" "), "lang").alias("prompt"), F.coalesce(F.nullif(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit("")), "source").alias("chosen"), F.to_json(F.struct("lang", F.col("n_chars").alias("n"))).alias("message"))


# Text ------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({SQUEEZE % 'lower(text)'}) AS norm, md5({SQUEEZE % 'text'}) AS squeezed FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm"), F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@query(f"SELECT doc_id, len({TOKENS % 'text'})::BIGINT AS n_tokens, md5(array_to_string({TOKENS % 'text'}, ' ')) AS tokens FROM documents")
def tokenize(spark, d):
    k = T.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.md5(F.array_join(k, " ")).alias("tokens"))


@query(f"SELECT doc_id, len(list_filter(string_split({SQUEEZE % 'text'}, ' '), lambda w: w <> ''))::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM documents")
def word_char_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, md5(replace(replace(translate(text, '–—‘’“”éèêàâôûçñüäö', '--''''\"\"eeeaaoucnuao'), '…', '...'), 'ß', 'ss')) AS folded, translate(lang, 'é', 'e') AS lang FROM documents")
def fold_all_strings(spark, d):
    return T.fold_strings(t(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", F.md5("text").alias("folded"), "lang")


@query(f"SELECT gram, count(*) AS n FROM {NG} GROUP BY gram HAVING count(*) >= 75")
def overused_ngrams(spark, d):
    return ngrams.overused(english(spark, d), "text", 75)


@query(f"SELECT gram, count(*) AS n FROM {NG} GROUP BY gram ORDER BY n DESC, gram LIMIT 50")
def ngram_doc_freq_top50(spark, d):
    return ngrams.top(ngrams.document_frequency(english(spark, d), "text"), 50)


@query(f"SELECT w AS gram, count(*) AS n FROM (SELECT unnest(string_split({SQUEEZE % ('regexp_replace(lower(text), ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_' + chr(92) + 's]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ')) w FROM {EN}) WHERE w <> '' AND w NOT IN ({', '.join(chr(39) + w + chr(39) for w in ngrams.STOP)}) GROUP BY w ORDER BY n DESC, gram LIMIT 15")
def top_terms(spark, d):
    return ngrams.top(ngrams.term_frequency(english(spark, d), "text", 1), 15)


@query(f"WITH g AS {NG}, o AS (SELECT gram, count(*) n FROM g GROUP BY gram HAVING count(*) >= 75), p AS (SELECT doc_id, sum(ln(1 + n::DOUBLE)) p FROM g JOIN o USING (gram) GROUP BY doc_id) SELECT doc_id, round(coalesce(p, 0), 6) AS repetition_penalty, round(1/(1+round(coalesce(p, 0), 6)), 6) AS weight FROM {EN} LEFT JOIN p USING (doc_id)")
def repetition_weight(spark, d):
    en = english(spark, d)
    return ngrams.repetition(en, "doc_id", "text", ngrams.overused(en, "text", 75)).select("doc_id", "repetition_penalty", "weight")


@query(f"WITH g AS {NG}, o AS (SELECT gram, count(*) n FROM g GROUP BY gram HAVING count(*) >= 75), h AS (SELECT doc_id, gram, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) rn FROM g JOIN o USING (gram)) SELECT doc_id, round(sum(ln(1 + n::DOUBLE)), 4) AS penalty, string_agg(CASE WHEN rn <= 10 THEN gram END, '|' ORDER BY rn) AS phrases FROM h GROUP BY doc_id ORDER BY penalty DESC, doc_id LIMIT 25")
def top_downweighted(spark, d):
    en = english(spark, d)
    h = ngrams.hits(en, "doc_id", "text", ngrams.overused(en, "text", 75))
    agg = h.groupBy("doc_id").agg(F.round(F.sum(F.log1p(F.col("n").cast("double"))), 4).alias("penalty"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))).alias("p"))
    return agg.orderBy(F.desc("penalty"), "doc_id").limit(25).select("doc_id", "penalty", F.array_join(F.transform(F.slice("p", 1, 10), lambda s: s["gram"]), "|").alias("phrases"))


@query(f"SELECT tpl AS template, count(*) AS n FROM (SELECT CASE WHEN len(k) < 2 THEN '' ELSE k[1] || ' ' || k[2] END tpl FROM (SELECT {TOKENS % 'text'} k FROM documents)) WHERE tpl <> '' GROUP BY tpl")
def opening_templates(spark, d):
    return t(spark, d, "documents").select(T.opening_template(T.tokens(F.col("text"))).alias("template")).filter("template <> ''").groupBy("template").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT doc_id, unnest({TOKENS % 'text'}) w FROM documents), c AS (SELECT doc_id, w, count(*) n FROM w GROUP BY ALL), m AS (SELECT doc_id, round(max(n)/sum(n), 6) f FROM c GROUP BY doc_id) SELECT doc_id, coalesce(f, 0) AS repeat_fraction, coalesce(f, 0) >= 0.35 AS is_high_repeat FROM documents LEFT JOIN m USING (doc_id)")
def token_repeat(spark, d):
    docs = t(spark, d, "documents")
    f = F.coalesce(r6(T.max_repeat_fraction(T.tokens(F.col("text")))), F.lit(0.0))
    return docs.select("doc_id", f.alias("repeat_fraction")).withColumn("is_high_repeat", F.col("repeat_fraction") >= 0.35)


_COPY = f"SELECT conv_id, turn, src, cand, {TOKENS % 'src'} s, {TOKENS % 'cand'} c FROM ({PAIRS})"


@query(f"SELECT conv_id, turn, CASE WHEN len(s) = 0 OR len(c) = 0 THEN 0.0 ELSE round(len(list_filter(c, lambda x: list_contains(s, x)))/len(c), 6) END AS overlap FROM ({_COPY})")
def lexical_overlap(spark, d):
    return pairs_of_turns(spark, d).select("conv_id", "turn", r6(T.lexical_overlap(T.tokens(F.col("src")), T.tokens(F.col("cand")))).alias("overlap"))


def _has(n: int) -> str:
    g = lambda a: f"list_transform(generate_series(1, len({a})-{n - 1}), lambda i: array_to_string({a}[i:i+{n - 1}], ' '))"
    return f"(len(s) >= {n} AND len(c) >= {n} AND list_has_any({g('s')}, {g('c')}))"


@query(f"SELECT conv_id, turn, CASE WHEN len(s) < 2 OR len(c) < 2 THEN 0.0 ELSE round((CASE WHEN {_has(4)} THEN 4 WHEN {_has(3)} THEN 3 WHEN {_has(2)} THEN 2 ELSE 0 END)/greatest(1, least(len(s), len(c), 4)), 6) END AS shared_ratio FROM ({_COPY})")
def shared_ngram_ratio(spark, d):
    return pairs_of_turns(spark, d).select("conv_id", "turn", r6(T.longest_shared_ratio(T.tokens(F.col("src")), T.tokens(F.col("cand")))).alias("shared_ratio"))


@query(f"SELECT conv_id, turn, CASE WHEN {SQUEEZE % 'lower(src)'} = {SQUEEZE % 'lower(cand)'} THEN 1.0 ELSE 0.0 END AS exact_copy FROM ({PAIRS})")
def exact_copy(spark, d):
    return pairs_of_turns(spark, d).select("conv_id", "turn", T.exact_copy(F.col("src"), F.col("cand")).alias("exact_copy"))


@query(f"SELECT conv_id, turn, len(list_distinct(list_concat(s, c)))::BIGINT AS union_size, len(list_filter(c, lambda x: list_contains(s, x)))::BIGINT AS shared FROM ({_COPY})")
def token_set_ops(spark, d):
    p = pairs_of_turns(spark, d).select("conv_id", "turn", T.tokens(F.col("src")).alias("s"), T.tokens(F.col("cand")).alias("c"))
    return p.select("conv_id", "turn", F.size(F.array_union("s", "c")).cast("long").alias("union_size"), F.size(F.filter("c", lambda x: F.array_contains(F.col("s"), x))).cast("long").alias("shared"))


@query()
def copy_penalty(spark, d):
    ship(spark)
    p = pairs_of_turns(spark, d).repartition("conv_id", "turn").select("conv_id", "turn", T.copy_parts(F.col("src"), F.col("cand")).alias("p"))
    return p.select("conv_id", "turn", "p.*")


@query()
def failure_report(spark, d):
    ship(spark)
    p = pairs_of_turns(spark, d).repartition("conv_id", "turn")
    m = p.select(T.copy_parts(F.col("src"), F.col("cand")).alias("c"), T.max_repeat_fraction(T.tokens(F.col("cand"))).alias("repeat_fraction"))
    m = Scratch(spark, "failures").table(m.select("c.exact_copy", "c.sequence_similarity", "repeat_fraction"), "metrics")
    return rerank.failure_report(m)


@query()
def rouge(spark, d):
    ship(spark)
    p = pairs_of_turns(spark, d).repartition("conv_id", "turn").select(T.rouge(F.col("src"), F.col("cand")).alias("r")).select("r.*")
    return p.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


# Duplicates, samples, splits, order ------------------------------------------
@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY doc_id) rn FROM documents) WHERE rn = 1")
def dedupe_keep_first(spark, d):
    keyed = t(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("k"), F.lower("lang").alias("l"))
    return selection.keep_first(keyed, [F.col("k"), F.col("l")], "doc_id").select("doc_id")


@query(f"SELECT conv_id, coalesce(count(turn), 0)::BIGINT AS kept, md5(coalesce(string_agg(text, chr(10) ORDER BY turn), '')) AS texts FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, {SQUEEZE % 'lower(text)'} ORDER BY turn) rn FROM conversations WHERE {SQUEEZE % 'text'} <> '') USING (conv_id) WHERE rn IS NULL OR rn = 1 GROUP BY conv_id")
def candidate_dedupe(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    kept = F.filter(scorers.dedupe_candidates(F.col("c.text")), lambda x: x != "")
    return c.select("conv_id", F.size(kept).cast("long").alias("kept"), F.md5(F.array_join(kept, "\n")).alias("texts"))


@query("SELECT l_orderkey, string_agg(k, ',' ORDER BY p, k) AS kept FROM (SELECT l_orderkey, k, min(l_linenumber) p, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), k) rn FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus k FROM lineitem) GROUP BY 1, 2) WHERE rn <= 2 GROUP BY 1")
def truncate_candidates(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("k")))).alias("c"))
    return g.select("l_orderkey", F.array_join(scorers.first_distinct(F.col("c.k"), 2), ",").alias("kept"))


@query(f"SELECT p_partkey, p_retailprice FROM part ORDER BY round(-ln(greatest({U % ('42', 'p_partkey')}, 1e-12))/greatest(p_retailprice, 1e-8), 9), p_partkey LIMIT 500")
def weighted_sample(spark, d):
    return selection.weighted_sample(t(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), 500, "p_partkey")


_SPLIT = "CASE WHEN r <= %s THEN 'train' WHEN r <= %s THEN '%s' ELSE '%s' END"
_RANK = "(SELECT *, row_number() OVER (%s ORDER BY md5('42|' || c_custkey), c_custkey) r, count(*) OVER (%s) n FROM customer)"


@query(f"SELECT c_custkey, {_SPLIT % ('floor(n*0.8)', 'floor(n*0.9)', 'val', 'test')} AS split FROM {_RANK % ('', '')}")
def split_80_10_10(spark, d):
    return selection.split(t(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey, c_mktsegment, {_SPLIT % ('floor(n*0.8)', 'floor(n*0.9)', 'val', 'test')} AS split FROM {_RANK % ('PARTITION BY c_mktsegment', 'PARTITION BY c_mktsegment')}")
def split_by_source(spark, d):
    return selection.split(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 42, ["c_mktsegment"])


@query(f"SELECT c_custkey, {_SPLIT % ('n - ceil(n*0.2)', 'n - ceil(ceil(n*0.2)*0.5)', 'test', 'val')} AS split FROM {_RANK % ('', '')}")
def ceil_split(spark, d):
    return selection.split(t(spark, d, "customer").select("c_custkey"), "c_custkey", rule="ceil", names=("train", "test", "val"))


@query(f"SELECT split, c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment, {_SPLIT % ('floor(n*0.8)', 'floor(n*0.9)', 'val', 'test')} AS split FROM {_RANK % ('PARTITION BY c_mktsegment', 'PARTITION BY c_mktsegment')}) GROUP BY ALL")
def split_breakdown(spark, d):
    return split_by_source(spark, d).groupBy("split", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 10 + 1)::BIGINT AS batch, ceil((SELECT count(*) FROM labels)/10.0)::BIGINT AS batches FROM labels")
def batch_index(spark, d):
    lab = t(spark, d, "labels").select("doc_id")
    n = lab.agg(F.ceil(F.count("*") / 10).alias("batches"))
    return selection.with_one_row(selection.positions(lab, "doc_id"), n).select("doc_id", (F.floor(F.col("pos") / 10) + 1).alias("batch"), "batches")


@query("SELECT doc_id, quality, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT % 4 AS worker FROM labels")
def rank_stride(spark, d):
    return selection.positions(t(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", (F.col("pos") % 4).alias("worker"))


@query(f"SELECT c_custkey, split, row_number() OVER (PARTITION BY split ORDER BY md5('44|' || c_custkey), c_custkey)::BIGINT AS position FROM (SELECT c_custkey, {_SPLIT % ('floor(n*0.8)', 'floor(n*0.9)', 'val', 'test')} AS split FROM {_RANK % ('PARTITION BY c_mktsegment', 'PARTITION BY c_mktsegment')})")
def combined_splits(spark, d):
    return selection.combine_splits(split_by_source(spark, d).select("c_custkey", "split"), "c_custkey", seed=42)


@query("SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id) ORDER BY quality DESC, n_chars DESC, doc_id")
def curriculum_order(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("doc_id", "quality", "n_chars").orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def sample_100(spark, d):
    return selection.hash_sample(t(spark, d, "documents").select("doc_id", "source"), 100, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 5")
def random_examples(spark, d):
    return selection.hash_sample(t(spark, d, "documents").select("doc_id"), 5, "doc_id", 7)


@query("SELECT doc_id, md5('44|' || doc_id) AS shuffle_key FROM documents ORDER BY 2, 1")
def hash_shuffle(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.concat_ws("|", F.lit("44"), F.col("doc_id").cast("string"))).alias("shuffle_key")).orderBy("shuffle_key", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT greatest(500 - (SELECT count(*) FROM labels), 0)")
def limit_remaining(spark, d):
    done = t(spark, d, "labels")
    return selection.remaining(t(spark, d, "documents").select("doc_id"), done, "doc_id").orderBy("doc_id").limit(max(500 - done.count(), 0))


@query("SELECT o_custkey, o_orderkey, o_totalprice > coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM orders")
def best_checkpoint_flags(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return losses.best_so_far(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "is_best")


@query("WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) i, o_totalprice > coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) b FROM orders), g AS (SELECT *, i - max(CASE WHEN b THEN i END) OVER (PARTITION BY o_custkey ORDER BY i) since FROM f) SELECT o_custkey, o_orderkey, b AS is_best FROM (SELECT *, coalesce(max(CASE WHEN since >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) past FROM g) WHERE past = 0")
def early_stop(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return losses.early_stop(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", patience=2).select("o_custkey", "o_orderkey", "is_best")


@query("SELECT p_partkey, p_retailprice - avg(p_retailprice) OVER () > 0 AS above, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey), 4) AS running FROM part")
def cumulative_weight(spark, d):
    p = t(spark, d, "part")
    p = selection.with_one_row(p, p.agg(F.avg("p_retailprice").alias("m")))
    return p.select("p_partkey", (F.col("p_retailprice") - F.col("m") > 0).alias("above"), F.round(F.sum("p_retailprice").over(W.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(W.unboundedPreceding, 0)), 4).alias("running"))


# Reranking -------------------------------------------------------------------
@query(f"SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) rn FROM ({SCORED})) WHERE rn = 1")
def rerank_best(spark, d):
    return selection.argmax(scored(spark, d).select("l_orderkey", "l_linenumber", "score"), ["l_orderkey"], "score", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber)::BIGINT AS rank FROM ({SCORED})")
def rerank_ranks(spark, d):
    return rerank.ranked(scored(spark, d), ["l_orderkey"], "score", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


_CR = "SELECT c.l_orderkey, c.txt AS chosen, r.txt AS rejected, c.l_linenumber AS chosen_pos, r.l_linenumber AS rejected_pos, round(c.score - r.score, 6) AS score_margin FROM k c JOIN k r USING (l_orderkey)"
_K = f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) rk, count(*) OVER (PARTITION BY l_orderkey) n FROM ({SCORED}))"


@query(f"{_K} {_CR} WHERE c.rk = 1 AND r.rk = r.n AND r.n > 1 AND round(c.score - r.score, 6) >= 0.05 AND c.txt <> r.txt")
def preference_pairs_best_worst(spark, d):
    return rerank.best_vs_worst(scored(spark, d), ["l_orderkey"], "score", "l_linenumber", "txt", 0.05)


@query(f"{_K} {_CR} WHERE c.rk < r.rk AND round(c.score - r.score, 6) >= 0.05 AND c.txt <> r.txt")
def preference_pairs_all(spark, d):
    return rerank.all_pairs(scored(spark, d), ["l_orderkey"], "score", "l_linenumber", "txt", 0.05)


_GRID = "(SELECT (row_number() OVER () - 1)::INT grid_id, s style_weight, m similarity_weight, c copy_weight, f fluency_weight, g margin FROM (SELECT * FROM (SELECT unnest([1.5, 2.5]) s), (SELECT unnest([0.75, 1.25]) m), (SELECT unnest([1.0, 2.0]) c), (SELECT unnest([0.0, 0.15]) f), (SELECT unnest([0.05, 0.2]) g) ORDER BY s, m, c, f, g))"
_SWEEP = f"WITH g AS {_GRID}, x AS (SELECT grid_id, margin, l_orderkey, l_linenumber, style, similarity, copy, perplexity, round(style_weight*style + similarity_weight*similarity - copy_weight*copy - fluency_weight*ln(greatest(perplexity, 1e-8)), 6) score FROM ({SCORED.replace(', round(2.0', ', 0 * round(2.0').replace(' AS score', ' AS unused')}), g), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, l_orderkey ORDER BY score DESC, l_linenumber) rn FROM x) WHERE rn = 1), p AS (SELECT a.grid_id, count(*) n FROM x a JOIN x b ON a.grid_id = b.grid_id AND a.l_orderkey = b.l_orderkey AND a.score > b.score AND round(a.score - b.score, 6) >= a.margin GROUP BY 1)"


def _grid(spark):
    return rerank.weight_grid(spark, [1.5, 2.5], [0.75, 1.25], [1.0, 2.0], [0.0, 0.15], [0.05, 0.2])


@query(f"{_SWEEP} SELECT w.grid_id, round(avg(style), 6) AS avg_style, round(avg(similarity), 6) AS avg_similarity, round(avg(copy), 6) AS avg_copy, round(avg(perplexity), 6) AS avg_perplexity, coalesce(max(p.n), 0)::BIGINT AS pair_count FROM w LEFT JOIN p USING (grid_id) GROUP BY w.grid_id")
def reranker_sweep(spark, d):
    return rerank.sweep(scored(spark, d).drop("score"), _grid(spark), "l_orderkey", "l_linenumber")


@query(f"{_SWEEP} SELECT w.grid_id, round(2*avg(style) + avg(similarity) - avg(CASE WHEN copy >= 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN copy >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS selection_score FROM w GROUP BY w.grid_id ORDER BY 2 DESC, 1 LIMIT 1")
def sweep_best(spark, d):
    b = rerank.swept(scored(spark, d).drop("score"), _grid(spark), "l_orderkey", "l_linenumber")
    rate = lambda at: F.avg((F.col("best.copy") >= at).cast("double"))
    return b.groupBy("grid_id").agg(r6(rerank.selection_score(F.avg("best.style"), F.avg("best.similarity"), rate(1.0), rate(0.9))).alias("selection_score")).orderBy(F.desc("selection_score"), "grid_id").limit(1)


# Scores and losses -----------------------------------------------------------
@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = t(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", r6(scorers.cosine(F.col("embedding"), F.col("e2"))).alias("cosine"))


@query("SELECT l_orderkey, l_linenumber, round(exp(l_tax*10)/(exp(l_discount*10) + exp(l_tax*10)), 6) AS p, round(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 1 - l_discount END, 6) AS positive, round(CASE WHEN l_linestatus = 'O' THEN l_tax ELSE 1 - l_tax END, 6) AS directed FROM lineitem")
def softmax_flip(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(scorers.softmax2(F.col("l_discount") * 10, F.col("l_tax") * 10)).alias("p"), r6(scorers.label_probability(F.col("l_returnflag"), F.col("l_discount"), "R")).alias("positive"), r6(scorers.directed(F.col("l_tax"), F.col("l_linestatus") == "O")).alias("directed"))


@query("SELECT l_orderkey, round(exp(sum(l_discount)/greatest(count(l_discount), 1)), 6) AS perplexity FROM lineitem GROUP BY l_orderkey")
def perplexity_agg(spark, d):
    return losses.perplexity(t(spark, d, "lineitem"), "l_orderkey", F.col("l_discount"))


@query("SELECT round(exp(avg(m)), 6) AS perplexity FROM (SELECT w, avg(value/1000) m FROM events, LATERAL (SELECT unnest(generate_series(greatest(ceil((event_id - 1023)/512.0), 0)::BIGINT, event_id // 512)) w) GROUP BY w)")
def strided_perplexity(spark, d):
    return losses.strided_perplexity(t(spark, d, "events").select("event_id", (F.col("value") / 1000).alias("nll")), "event_id", "nll", 1024, 512)


@query("SELECT round(sum(l_discount*l_tax*(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END))/nullif(sum(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END), 0), 6) AS loss FROM lineitem")
def masked_loss(spark, d):
    return losses.masked_loss(t(spark, d, "lineitem"), F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag") != "N")


@query("SELECT round(avg(v), 6) AS mean FROM (SELECT event_id // 64 b, avg(value) v FROM events GROUP BY 1)")
def batch_mean_of_means(spark, d):
    return losses.mean_of_batch_means(t(spark, d, "events"), "event_id", 64, F.col("value"))


@query("WITH x AS (SELECT 0.1*((l_discount - l_tax)*100 - (l_quantity/50 - l_tax)) z FROM lineitem) SELECT round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS loss, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM x")
def dpo_loss(spark, d):
    z = losses.dpo_logit(F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity") / 50, F.col("l_tax"))
    return t(spark, d, "lineitem").select(z.alias("z")).agg(r6(F.avg(losses.neg_log_sigmoid(F.col("z")))).alias("loss"), r6(F.avg((F.col("z") > 0).cast("double"))).alias("accuracy"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN -l_discount ELSE 0 END), 6) AS logp FROM lineitem GROUP BY l_orderkey")
def sequence_logp(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (-F.col("l_discount")).alias("p"), (F.col("l_returnflag") == "N").cast("int").alias("m")))).alias("a"))
    return g.select("l_orderkey", r6(losses.sequence_logp(F.col("a.p"), F.col("a.m"))).alias("logp"))


_AC = "WITH s AS (SELECT DISTINCT l_orderkey e, l_suppkey % 10 k FROM lineitem WHERE l_linenumber <= 2), f AS (SELECT l_orderkey e, l_linenumber p, l_suppkey % 10 k, l_discount d FROM lineitem WHERE (l_orderkey, l_partkey % 10) NOT IN (SELECT e, k FROM s))"


@query(f"{_AC} SELECT round(avg(m), 6) AS anti_copy FROM (SELECT e, avg(m) m FROM (SELECT f.e, p, sum(CASE WHEN s.k IS NOT NULL THEN d ELSE 0 END) m FROM f LEFT JOIN s ON f.e = s.e AND f.k = s.k GROUP BY 1, 2) GROUP BY e)")
def anti_copy_mass(spark, d):
    li = t(spark, d, "lineitem")
    src = li.filter("l_linenumber <= 2").select("l_orderkey", (F.col("l_suppkey") % 10).alias("token"))
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("tok"), (F.col("l_partkey") % 10).alias("gold"), "l_discount")
    return losses.anti_copy_mass(rows, "l_orderkey", "l_linenumber", "tok", F.col("l_discount"), "gold", src)


@query("SELECT vec_id, array_to_string(list_transform(x, lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), ',') AS masked, array_to_string(list_transform(x, lambda i: CASE WHEN i < 0 THEN 0 ELSE least(i, 4) END), ',') AS clamped FROM (SELECT vec_id, list_transform(embedding[1:8], lambda v: floor(v*10)::INT) x FROM embeddings)")
def pad_mask(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform(losses.truncate(F.col("embedding"), 8), lambda v: F.floor(v * 10).cast("int")).alias("x"))
    return e.select("vec_id", F.array_join(losses.mask_padding(F.col("x"), 0), ",").alias("masked"), F.array_join(losses.clamp_ids(F.col("x"), 0, 5), ",").alias("clamped"))


# Statistics ------------------------------------------------------------------
@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, CASE WHEN corr(l_quantity, l_extendedprice) < -0.3 THEN 'negative' WHEN corr(l_quantity, l_extendedprice) > 0.3 THEN 'positive' ELSE 'weak' END AS conclusion FROM lineitem")
def pearson_ols(spark, d):
    x, y = "l_quantity", "l_extendedprice"
    return t(spark, d, "lineitem").agg(r6(F.corr(x, y)).alias("pearson"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), stats.conclusion(F.corr(x, y)).alias("conclusion"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1)/2.0 a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1)/2.0 b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return stats.spearman(t(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(max(l_extendedprice), 6) AS max FROM lineitem")
def describe_scores(spark, d):
    return stats.describe(t(spark, d, "lineitem"), "l_extendedprice")


def _b(v: str, lo: str, hi: str, n: int) -> str:
    return f"least(floor(({v} - {lo})/(({hi} - {lo})/{n})), {n - 1})::INT"


@query(f"SELECT l_returnflag, {_b('l_extendedprice', 'lo', 'hi', 50)} AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem) GROUP BY ALL")
def hist_by_hue(spark, d):
    return stats.histogram(t(spark, d, "lineitem"), "l_extendedprice", 50, ["l_returnflag"])


@query(f"SELECT {_b('value', 'lo', 'hi', 30)} AS bin, count(*) AS n FROM events, (SELECT min(value) lo, max(value) hi FROM events) WHERE value IS NOT NULL GROUP BY ALL")
def hist1d(spark, d):
    return stats.histogram(t(spark, d, "events"), "value", 30)


@query(f"SELECT {_b('l_quantity', 'a', 'b', 100)} AS bx, {_b('l_extendedprice', 'x', 'y', 100)} AS by, count(*) AS n FROM lineitem, (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) x, max(l_extendedprice) y FROM lineitem) GROUP BY ALL")
def hist2d(spark, d):
    return stats.histogram2d(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 100)


@query("WITH s AS (SELECT (l_quantity - a)/((b - a)/40) u, (l_extendedprice - x)/((y - x)/23) v FROM lineitem, (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) x, max(l_extendedprice) y FROM lineitem)), f AS (SELECT *, power(u - floor(u + 0.5), 2) + 3*power(v - floor(v + 0.5), 2) < power(u - floor(u) - 0.5, 2) + 3*power(v - floor(v) - 0.5, 2) AS first FROM s) SELECT CASE WHEN first THEN 0 ELSE 1 END AS lattice, CASE WHEN first THEN floor(u + 0.5) ELSE floor(u) END::INT AS i, CASE WHEN first THEN floor(v + 0.5) ELSE floor(v) END::INT AS j, count(*) AS n FROM f GROUP BY ALL")
def hexbin(spark, d):
    return stats.hexbin(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH s AS (SELECT count(l_quantity) n, 0.5*power(count(l_quantity)::DOUBLE, -0.2)*stddev_samp(l_quantity) h, min(l_quantity) lo, max(l_quantity) hi FROM lineitem) SELECT point::INT AS point, round(lo + point*(hi-lo)/49, 6) AS x, round(sum(exp(0 - power((lo + point*(hi-lo)/49 - l_quantity)/h, 2)/2))/(max(n)*max(h)*sqrt(2*pi())), 9) AS density FROM lineitem, s, range(0, 50) r(point) GROUP BY point, lo, hi")
def kde_grid(spark, d):
    return stats.kde(t(spark, d, "lineitem"), "l_quantity")


@query("SELECT count(*) AS total, count(*) FILTER (coalesce(l_discount, 1.0) < 0.02) AS low FROM lineitem")
def low_score_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("total"), F.count_if(F.coalesce("l_discount", F.lit(1.0)) < 0.02).alias("low"))


@query("SELECT l_returnflag AS run, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS discount_o, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS discount_f, count(*) FILTER (l_linestatus = 'O') AS n_o, count(*) FILTER (l_linestatus = 'F') AS n_f FROM lineitem GROUP BY 1")
def summary_pivot(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).pivot("l_linestatus", ["O", "F"]).agg(r6(F.avg("l_discount")).alias("discount"), F.count(F.lit(1)).alias("n"))
    return p.select("run", F.col("O_discount").alias("discount_o"), F.col("F_discount").alias("discount_f"), F.coalesce("O_n", F.lit(0).cast("long")).alias("n_o"), F.coalesce("F_n", F.lit(0).cast("long")).alias("n_f"))


@query("SELECT l_returnflag AS run, lower(l_linestatus) AS slice, count(*) AS n FROM lineitem GROUP BY ALL")
def summary_unpivot(spark, d):
    return summary_pivot(spark, d).unpivot(["run"], ["n_o", "n_f"], "slice", "n").filter("n > 0").withColumn("slice", F.substring("slice", 3, 1))


@query("SELECT l_linenumber, round(ln(1 + l_quantity), 6) AS a, round(ln(greatest(l_extendedprice, 1e-8)), 6) AS b, round(exp(-l_discount), 6) AS c, l_orderkey FROM lineitem")
def scalar_math(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.log1p("l_quantity")).alias("a"), r6(F.ln(F.greatest("l_extendedprice", F.lit(1e-8)))).alias("b"), r6(F.exp(-F.col("l_discount"))).alias("c"))


@query("SELECT event_id, format('{:02d}:{:02d}:{:02d}', event_id // 3600, (event_id // 60) % 60, event_id % 60) AS duration, least(15*(event_id % 20), 120)::BIGINT AS backoff, 5*(event_id % 7) AS failure_wait, floor(event_id*0.05)::BIGINT AS warmup, round(event_id*0.7/greatest(event_id, 1)*(100000 - event_id), 3) AS eta_s FROM events")
def run_arithmetic(spark, d):
    e = F.col("event_id")
    return t(spark, d, "events").select("event_id", runs.duration(e).alias("duration"), runs.backoff(e % 20).alias("backoff"), runs.failure_wait(e % 7).alias("failure_wait"), runs.warmup_steps(e, 0.05).alias("warmup"), F.round(F.coalesce(runs.time_left(e * 0.7, e, F.lit(100000)), F.lit(0.0)), 3).alias("eta_s"))


@query("SELECT event_type, count(*) AS calls, round(sum(620*0.1 + value*0.4), 4) AS cost FROM events GROUP BY event_type")
def cost_sum(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.lit(620) * 0.1 + F.col("value") * 0.4), 4).alias("cost"))


# JSON, logs, sources, sinks --------------------------------------------------
@query("SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("SELECT event_id, 2::BIGINT AS salvaged, (event_id % 3)::BIGINT AS fenced FROM events")
def json_salvage(spark, d):
    e = F.col("event_id").cast("string")
    cut = F.concat(F.lit('reply: [{"a":"x'), e, F.lit('"},{"a":"y"},{"a":"z'))
    k = (F.col("event_id") % 3).cast("int")
    fenced = F.concat(F.lit('Sure:\n```json\n{"headlines":["'), F.array_join(F.when(k == 0, F.array(F.lit(" "))).otherwise(F.array_repeat(F.concat(F.lit("H"), e), k)), '","'), F.lit('"]}\n```'))
    return t(spark, d, "events").select("event_id", F.size(jsonrepair.salvage(cut, "struct<a:string>")).cast("long").alias("salvaged"), F.size(jsonrepair.headlines(fenced)).cast("long").alias("fenced"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 1000 + 5 ELSE 65 END AS delay, ['rate', 'unavailable', 'unavailable', 'other'][event_id % 4 + 1] AS kind FROM events")
def retry_delay_parse(spark, d):
    e = F.col("event_id")
    delay = F.concat(F.lit("Error 429: Please Retry in "), e % 1000, F.lit("s"))
    msg = F.when(e % 4 == 0, delay).when(e % 4 == 1, "code 503, try later").when(e % 4 == 2, "status: UNAVAILABLE").otherwise("connection reset")
    x = t(spark, d, "events").select("event_id", msg.alias("m"))
    return x.select("event_id", jsonrepair.retry_delay(F.col("m")).cast("long").alias("delay"), jsonrepair.error_class(F.col("m")).alias("kind"))


@query("SELECT l_returnflag AS baseline, round(avg(l_discount), 4) AS style_accuracy, round(avg(l_tax), 4) AS exact_copy_rate FROM lineitem GROUP BY 1")
def metric_regex_parse(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 4).alias("x"), F.round(F.avg("l_tax"), 4).alias("y"))
    log = F.format_string("== %s ==\nStyle Accuracy (prob)      : %.4f\nContent Preservation (cosine): 0.5\nLinguistic Fluency (ppl): 10.0\nExact Copy Rate : %.4f\nNear-Copy Rate (sim >= 0.90): 0.1\n", "l_returnflag", "x", "y")
    p = a.select(F.col("l_returnflag").alias("baseline"), log.alias("log")).select("baseline", *io.log_metrics(F.col("log")))
    return p.select("baseline", "style_accuracy", "exact_copy_rate")


@query("SELECT event_id, event_type, value FROM events")
def corrupt_record_scan(spark, d):
    s = Scratch(spark, "corrupt")
    ev = t(spark, d, "events").select("event_id", "event_type", "value")
    lines = ev.select(F.to_json(F.struct("*")).alias("value")).union(ev.filter("event_id % 10 = 0").select(F.lit("bad{").alias("value")))
    lines.write.text(f"{s.path}/lines")
    rows, _ = io.read_jsonl(spark, f"{s.path}/lines", "event_id long, event_type string, value double", "report", ["event_id"])
    return rows


@query("SELECT count(*) FILTER (event_id % 10 = 0) AS rejects FROM events")
def error_routing(spark, d):
    ev = t(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("bad{")).otherwise(F.to_json(F.struct("event_id"))).alias("line"))
    p = ev.withColumn("parsed", F.from_json("line", "event_id long").getField("event_id"))
    return jobs.route_errors(p, "parsed", "line")[1].agg(F.count("*").alias("rejects"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, d):
    s = Scratch(spark, "csv")
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    io.write_csv(docs.filter("doc_id % 2 = 0"), f"{s.path}/x")
    io.write_csv(docs.filter("doc_id % 2 = 1"), f"{s.path}/x", mode="append")
    return io.read_csv(spark, f"{s.path}/x", "doc_id long, lang string, source string, n_chars long")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, p_name FROM part")
def csv_inferred(spark, d):
    """Types come from the data; the usual texts for missing values become null."""
    s = Scratch(spark, "inferred")
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice").cast("string")).otherwise(F.when(F.col("p_partkey") % 2 == 0, "N/A").otherwise("nan")).alias("price"), "p_name")
    io.write_csv(p, f"{s.path}/x")
    return io.read_csv(spark, f"{s.path}/x", na=io.NA_TEXTS, infer=True).select(F.col("p_partkey").cast("long").alias("p_partkey"), "price", "p_name")


@query("SELECT doc_id, text, lang FROM documents WHERE lang <> 'en'")
def json_ascii_roundtrip(spark, d):
    s = Scratch(spark, "ascii")
    io.write_jsonl(t(spark, d, "documents").filter("lang <> 'en'").select("doc_id", "text", "lang"), f"{s.path}/x", ascii_only=True)
    lines = spark.read.text(f"{s.path}/x")
    bad = lines.filter(F.length("value") != F.octet_length("value")).select(F.lit(-1).cast("long").alias("doc_id"), F.col("value").alias("text"), F.lit("").alias("lang"))
    return io.read_jsonl(spark, f"{s.path}/x", "doc_id long, text string, lang string", "fail")[0].unionByName(bad)


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def json_roundtrip(spark, d):
    s = Scratch(spark, "json")
    io.write_jsonl(t(spark, d, "documents").select("doc_id", "text"), f"{s.path}/x")
    return io.read_jsonl(spark, f"{s.path}/x", "doc_id long, text string", "fail", ["doc_id"])[0].select("doc_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, role FROM conversations")
def json_array_scan(spark, d):
    s = Scratch(spark, "array")
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    # one array document a file: a part file holds one pretty array over several lines
    docs = c.groupBy(F.pmod("conv_id", F.lit(8)).alias("g")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "role")), {"pretty": "true"}).alias("value"))
    docs.write.partitionBy("g").text(f"{s.path}/x")
    return io.read_json_array(spark, f"{s.path}/x", "conv_id long, turn long, role string").select("conv_id", "turn", "role")


@query(f"{_K} SELECT l_orderkey % 2 AS split, count(*) AS n FROM ({_CR} WHERE c.rk = 1 AND r.rk = r.n AND r.n > 1 AND round(c.score - r.score, 6) >= 0.05 AND c.txt <> r.txt) GROUP BY 1")
def partitioned_pairs(spark, d):
    s = Scratch(spark, "pairs")
    preference_pairs_best_worst(spark, d).withColumn("split", F.col("l_orderkey") % 2).write.partitionBy("split").json(f"{s.path}/x")
    return spark.read.schema("l_orderkey long, split long").json(f"{s.path}/x").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT least(greatest(max(length(source)), 6) + 4, 60)::INT AS source, least(greatest(max(length(lang)), 4) + 4, 60)::INT AS lang FROM documents")
def sheet_widths(spark, d):
    return io.sheet_widths(t(spark, d, "documents").select("source", "lang"))


# Events and streams ----------------------------------------------------------
@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 4) AS window_sum FROM events")
def rate_window_60s(spark, d):
    return losses.rate_window(t(spark, d, "events"), ["user_id"], "ts", "value").select("event_id", F.round("window_sum", 4).alias("window_sum"))


@query("SELECT event_id, round(sum(value) OVER w, 4) > 500 AS blocked, CASE WHEN round(sum(value) OVER w, 4) > 500 THEN round((60000000 - (epoch_us(ts) - min(epoch_us(ts)) OVER w))/1e6, 6) ELSE 0.0 END AS wait_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def token_budget(spark, d):
    return losses.token_budget(t(spark, d, "events"), ["user_id"], "ts", "value", 500.0).select("event_id", "blocked", "wait_s")


@query("SELECT event_id, round(greatest(0, 3.0 - coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))/1e6, 3.0)), 6) AS wait_s FROM events")
def min_gap(spark, d):
    return losses.wait_before(t(spark, d, "events"), ["user_id"], "ts", 3.0, "event_id").select("event_id", "wait_s")


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def window_stream(spark, d):
    """The streaming job, run to its end over the table as a stream of files."""
    s = Scratch(spark, "windows")
    ev = t(spark, d, "events").select("event_id", "ts", "value")
    src = spark.readStream.schema(ev.schema).parquet(f"{d}/events.parquet*")
    q = jobs.windowed_sums(src, "ts", "value", late="3650 days").writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{s.path}/out")).option("checkpointLocation", f"{s.path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{s.path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 4).alias("total"), "n")


@query("SELECT event_id, event_type FROM events")
def append_resume_stream(spark, d):
    s = Scratch(spark, "resume")
    ev = t(spark, d, "events").select("event_id", "event_type")
    for run in (0, 1):  # the second run finds some keys done
        ev.filter((F.col("event_id") % 3 == run) | (F.col("event_id") % 3 == 2)).write.parquet(f"{s.path}/in/run={run}")
        q = jobs.append_new(spark, spark.readStream.schema("event_id long, event_type string, run int").parquet(f"{s.path}/in"), f"{s.path}/out", f"{s.path}/state", "event_id", lambda x: x.select("event_id", "event_type"))
        q.awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{s.path}/out").select("event_id", "event_type")


def _echo(texts: list[str]) -> list[list[str]]:
    """A provider for tests: the first three words, then the text, then the first three words again."""
    return [[" ".join(x.split()[:3]), x, " ".join(x.split()[:3])] for x in texts]


@query("SELECT conv_id, turn, CASE WHEN md5(first) = md5(src) THEN 1 ELSE 2 END AS candidates, md5(first) AS first FROM (SELECT conv_id, turn, src, array_to_string(string_split(src, ' ')[1:3], ' ') AS first FROM (SELECT conv_id, turn, text AS src FROM conversations WHERE role = 'user')) WHERE regexp_full_match(src, '[a-zA-Z.,]+( [a-zA-Z.,]+)*')")
def provider_candidates(spark, d):
    u = t(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src")).filter(F.col("src").rlike("^[a-zA-Z.,]+( [a-zA-Z.,]+)*$"))
    made = providers.generate(u, "src", _echo).withColumn("c", scorers.dedupe_candidates(F.col("candidates")))
    return made.select("conv_id", "turn", F.size("c").alias("candidates"), F.md5(F.col("c")[0]).alias("first"))


# Scorers and the whole mixture -----------------------------------------------
@query()
def score_fan_in(spark, d):
    p = scorers.candidates(pairs_of_turns(spark, d), "src", 3).select("conv_id", "turn", "src", F.posexplode(scorers.dedupe_candidates(F.col("candidates"))).alias("pos", "candidate"))
    s = scorers.score_all(p, "candidate", "src").withColumn("copy", T.lexical_overlap(T.tokens(F.col("src")), T.tokens(F.col("candidate"))))
    return s.withColumn("score", r6(rerank.linear_score(F.col("style"), F.col("similarity"), F.col("copy"), F.col("perplexity"), rerank.PRESETS["rerank"]))).select("conv_id", "turn", "pos", "score")


_WEIGHT = f"WITH g AS {NG}, o AS (SELECT gram, count(*) n FROM g GROUP BY gram HAVING count(*) >= 75), p AS (SELECT doc_id, sum(ln(1 + n::DOUBLE)) p FROM g JOIN o USING (gram) GROUP BY doc_id), w AS (SELECT doc_id, text, round(1/(1+round(coalesce(p, 0), 6)), 6) weight FROM {EN} LEFT JOIN p USING (doc_id))"


@query(f"{_WEIGHT}, s AS (SELECT doc_id, text, 'sampled' AS tag FROM w ORDER BY round(-ln(greatest({U % ('42', 'doc_id')}, 1e-12))/greatest(weight, 1e-8), 9), doc_id LIMIT (SELECT count(*) FROM documents WHERE lang <> 'en')), b AS (SELECT * FROM s UNION ALL SELECT doc_id, text, 'other' FROM documents WHERE lang <> 'en'), k AS (SELECT doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY tag, lower(text) ORDER BY doc_id) rn FROM b) WHERE rn = 1), r AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY md5(CASE WHEN tag = 'sampled' THEN '42' ELSE '43' END || '|' || doc_id), doc_id) r, count(*) OVER (PARTITION BY tag) n FROM k) SELECT {_SPLIT % ('floor(n*0.8)', 'floor(n*0.9)', 'val', 'test')} AS split, tag, count(*) AS n FROM r GROUP BY ALL")
def mixture_build(spark, d):
    """Weighted sample of English documents, de-duplicated, split by source: counts by split and source."""
    en = english(spark, d)
    w = ngrams.repetition(en, "doc_id", "text", ngrams.overused(en, "text", 75))
    other = t(spark, d, "documents").filter("lang <> 'en'").select("doc_id", "text", F.lit("other").alias("tag"))
    size = other.count()
    picked = selection.weighted_sample(w.select("doc_id", "weight"), F.col("weight"), size, "doc_id")
    a = en.join(picked.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", F.lit("sampled").alias("tag"))
    both = a.unionByName(other).select("doc_id", "tag", F.sha2(F.lower("text"), 256).alias("k"))
    kept = selection.keep_first(both, [F.col("tag"), F.col("k")], "doc_id").select("doc_id", "tag")
    seed = F.when(F.col("tag") == "sampled", 42).otherwise(43)
    return selection.split(kept, "doc_id", seed, ["tag"]).groupBy("split", "tag").agg(F.count("*").alias("n"))
