"""Reranking of scored candidates, preference pairs, weight sweeps and failure reports."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.operators.stats import quantiles


@dataclass(frozen=True)
class Weights:
    style: float = 2.0
    similarity: float = 1.0
    copy: float = 1.5
    fluency: float = 0.15


#: The two weight profiles in use, and the two margins.
PRESETS = {"default": Weights(), "rerank": Weights(1.0, 1.5, 1.0, 0.15)}
MARGINS = {"train": 0.05, "evaluate": 0.1}


def linear_score(style: Column, similarity: Column, copy: Column, perplexity: Column, w: Weights = Weights()) -> Column:
    return w.style * style + w.similarity * similarity - w.copy * copy - w.fluency * F.ln(F.greatest(perplexity, F.lit(1e-8)))


def ranked(df: DataFrame, group: list[str], score: str, position: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), position)))


def best_vs_worst(df: DataFrame, group: list[str], score: str, position: str, text: str, margin: float) -> DataFrame:
    """(group, chosen, rejected, margin): first against last of each group, in one aggregation."""
    order = F.struct(F.col(score), (-F.col(position)).alias("p"))
    row = F.struct(text, score, position)
    g = df.groupBy(*group).agg(F.max_by(row, order).alias("c"), F.min_by(row, order).alias("r"), F.count("*").alias("n"))
    return _margin(g.filter("n > 1"), group, score, position, text, margin)


def all_pairs(df: DataFrame, group: list[str], score: str, position: str, text: str, margin: float, most: int = 1000) -> DataFrame:
    """Every ordered pair of a group's candidates whose margin suffices.

    Quadratic in a candidate group by definition: a group of more than ``most`` candidates is
    an error, not cut. Pairs are made inside each group's array, after one shuffle.
    """
    row = F.struct(F.col(score).alias("o"), (-F.col(position)).alias("p"), F.struct(text, score, position).alias("s"))
    groups = df.groupBy(*group).agg(F.sort_array(F.collect_list(row), asc=False).alias("_g"))
    checked = F.when(F.size("_g") > most, F.raise_error(F.lit(f"a group has over {most} candidates"))).otherwise(F.col("_g"))
    groups = groups.select(*group, checked.alias("_g")).select(*group, "_g", F.posexplode("_g").alias("_i", "_c"))
    pairs = groups.select(*group, "_c", F.explode(F.slice("_g", F.col("_i") + 2, F.lit(most))).alias("_r"))
    better = F.struct("_c.o", "_c.p") > F.struct("_r.o", "_r.p")
    return _margin(pairs.filter(better).select(*group, F.col("_c.s").alias("c"), F.col("_r.s").alias("r")), group, score, position, text, margin)


def _margin(pairs: DataFrame, group, score, position, text, margin) -> DataFrame:
    d = pairs.select(*group, F.col(f"c.{text}").alias("chosen"), F.col(f"r.{text}").alias("rejected"), F.col(f"c.{position}").alias("chosen_pos"), F.col(f"r.{position}").alias("rejected_pos"), F.round(F.col(f"c.{score}") - F.col(f"r.{score}"), 6).alias("score_margin"))
    return d.filter((F.col("score_margin") >= margin) & (F.col("chosen") != F.col("rejected")))


def weight_grid(spark: SparkSession, style, similarity, copy, fluency, margin) -> DataFrame:
    """The Cartesian product of the parameter lists, numbered; as small as the lists make it."""
    rows = [(i, *map(float, x)) for i, x in enumerate(product(style, similarity, copy, fluency, margin))]
    return spark.createDataFrame(rows, "grid_id int, style_weight double, similarity_weight double, copy_weight double, fluency_weight double, margin double")


def swept(cands: DataFrame, grid: DataFrame, group: str, position: str) -> DataFrame:
    """(grid_id, best, pairs) for each grid row and candidate group.

    Candidates are shuffled once, into one array a group (a group is the candidates of one
    text, so it is small); the grid multiplies arithmetic inside the groups only. best is
    the winner's style, similarity, copy and perplexity, pairs the number of candidate pairs
    over the grid row's margin.
    """
    one = F.struct(F.col(position).alias("at"), "style", "similarity", "copy", "perplexity", F.ln(F.greatest("perplexity", F.lit(1e-8))).alias("fluency"))
    groups = cands.groupBy(group).agg(F.collect_list(one).alias("c"))

    def scored(x: Column) -> Column:
        s = F.col("style_weight") * x["style"] + F.col("similarity_weight") * x["similarity"] - F.col("copy_weight") * x["copy"] - F.col("fluency_weight") * x["fluency"]
        return F.struct(F.round(s, 6).alias("score"), (-x["at"]).alias("p"), x["style"].alias("style"), x["similarity"].alias("similarity"), x["copy"].alias("copy"), x["perplexity"].alias("perplexity"))

    each = groups.crossJoin(F.broadcast(grid)).select("grid_id", "margin", F.transform("c", scored).alias("s"))
    margin, near = F.col("margin"), 1e-5
    # rounded differences, as reported, decide where they are close to the margin
    over = lambda d: (d >= margin + near) | ((d > margin - near) & (F.round(d, 6) >= margin))
    pairs = F.aggregate(F.transform("s", lambda x: x["score"]), F.lit(0), lambda n, v: n + F.size(F.filter("s", lambda o: (o["score"] < v) & over(v - o["score"]))))
    return each.select("grid_id", F.array_max("s").alias("best"), pairs.alias("pairs"))


def sweep(cands: DataFrame, grid: DataFrame, group: str, position: str) -> DataFrame:
    """One row of metrics for each grid row: winners' means and the count of pairs over the margin.

    cands has style, similarity, copy, perplexity.
    """
    mean = lambda c: F.round(F.avg(f"best.{c}"), 6).alias(f"avg_{c}")
    return swept(cands, grid, group, position).groupBy("grid_id").agg(mean("style"), mean("similarity"), mean("copy"), mean("perplexity"), F.sum("pairs").alias("pair_count"))


def selection_score(style, similarity, exact, near):
    return 2 * style + similarity - exact - near


def failure_report(pairs: DataFrame, near: float = 0.9, repeat: float = 0.35) -> DataFrame:
    """One row of copy and repetition rates over rows with exact_copy, sequence_similarity and repeat_fraction.

    The table is read more than once (the median is exact and taken range by range), so one
    that is costly to make should be written first.
    """
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    median = quantiles(pairs, "sequence_similarity", [0.5])[0]
    return pairs.agg(F.count("*").alias("n_examples"), rate(F.col("exact_copy")).alias("exact_copy_rate"), rate(F.col("sequence_similarity") >= near).alias("near_copy_rate"), rate(F.col("sequence_similarity")).alias("avg_similarity"), F.round(F.lit(median).cast("double"), 6).alias("median_similarity"), rate(F.col("repeat_fraction")).alias("avg_repeat"), rate(F.col("repeat_fraction") >= repeat).alias("high_repeat_rate"))
