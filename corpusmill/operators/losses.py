"""Data-side arithmetic of training: masks, clamps, losses, perplexities over token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def mask_padding(ids: Column, pad: int, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, ignore).otherwise(x))


def clamp_ids(ids: Column, pad: int, vocabulary: int) -> Column:
    """Missing, NaN or negative ids become pad, large ones the last id."""
    return F.transform(ids, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (x < 0), pad).otherwise(F.least(x, F.lit(vocabulary - 1))))


def argmax_ids(scores: Column) -> Column:
    """The index of the largest score of each row of a table of scores (the first of equal ones; NaN never wins)."""
    best = lambda row: F.array_position(row, F.array_max(F.filter(row, lambda x: ~F.isnan(x)))) - 1
    return F.transform(scores, lambda row: best(row).cast("int"))


def truncate(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)


def masked_loss(rows: DataFrame, loss: Column, weight: Column, mask: Column) -> DataFrame:
    m = mask.cast("double")
    return rows.agg(F.round(F.try_divide(F.sum(loss * weight * m), F.sum(m)), 6).alias("loss"))


def mean_of_batch_means(rows: DataFrame, position: str, batch: int, value: Column, name: str = "mean") -> DataFrame:
    """Mean over batches of their means; the last, partial batch counts as much as any other."""
    per = rows.groupBy(F.floor(F.col(position) / batch).alias("b")).agg(F.avg(value).alias("v"))
    return per.agg(F.round(F.avg("v"), 6).alias(name))


def perplexity(rows: DataFrame, group: str, nll: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.round(F.exp(F.sum(nll) / F.greatest(F.count(nll), F.lit(1))), 6).alias("perplexity"))


def strided_perplexity(rows: DataFrame, position: str, nll: str, window: int, stride: int) -> DataFrame:
    """exp of the mean over windows of their mean loss; a token belongs to every window that covers it."""
    last = F.floor(F.col(position) / stride)
    first = F.greatest(F.ceil((F.col(position) - window + 1) / stride), F.lit(0))
    w = rows.select(nll, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("w"))
    return w.groupBy("w").agg(F.avg(nll).alias("m")).agg(F.round(F.exp(F.avg("m")), 6).alias("perplexity"))


def sequence_logp(logp: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(logp, mask, lambda l, m: F.when(m == 1, l).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def dpo_logit(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1) -> Column:
    return beta * ((pc - pr) - (rc - rr))


def neg_log_sigmoid(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def anti_copy_mass(rows: DataFrame, example: str, position: str, token: str, p: Column, gold: str, source: DataFrame) -> DataFrame:
    """Mean over positions whose gold token is not in the source of the probability on source tokens, averaged over examples."""
    free = rows.join(source.select(F.col(example), F.col("token").alias(gold)).distinct(), [example, gold], "left_anti")
    held = source.select(F.col(example), F.col("token").alias(token), F.lit(1).alias("_in")).distinct()
    mass = free.join(held, [example, token], "left").groupBy(example, position).agg(F.sum(F.when(F.col("_in") == 1, p).otherwise(0.0)).alias("m"))
    return mass.groupBy(example).agg(F.avg("m").alias("m")).agg(F.round(F.avg("m"), 6).alias("anti_copy"))


def best_so_far(df: DataFrame, partition: list[str], order: list[str], metric: str) -> DataFrame:
    """Flags rows whose metric strictly beats all before them."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("is_best", F.coalesce(F.col(metric) > F.max(metric).over(w), F.lit(True)))


def rate_window(df: DataFrame, partition: list[str], ts: str, amount: str, seconds: int = 60, tie: str = "event_id") -> DataFrame:
    """Adds window_sum: the amount in the trailing seconds (strictly fewer than that long ago)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_us", us).withColumn("window_sum", F.sum(amount).over(W.partitionBy(*partition).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0))).drop("_us")


def wait_before(df: DataFrame, partition: list[str], ts: str, least: float, tie: str) -> DataFrame:
    """Adds wait_s: what is missing to the least gap from the row before."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (us - F.lag(us).over(W.partitionBy(*partition).orderBy(us, tie))) / 1e6
    return df.withColumn("wait_s", F.round(F.greatest(F.lit(0.0), F.lit(least) - F.coalesce(gap, F.lit(least))), 6))


def early_stop(df: DataFrame, partition: list[str], order: list[str], metric: str, patience: int = 2) -> DataFrame:
    """The rows up to and including the one at which patience rows in a row have not beaten the best; with is_best."""
    w = W.partitionBy(*partition).orderBy(*order)
    d = best_so_far(df, partition, order, metric).withColumn("_i", F.row_number().over(w))
    since = F.col("_i") - F.max(F.when(F.col("is_best"), F.col("_i"))).over(w)
    d = d.withColumn("_stop", (since >= patience).cast("int"))
    over = F.coalesce(F.max("_stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_over", over).filter("_over = 0").drop("_i", "_stop", "_over")


def token_budget(df: DataFrame, partition: list[str], ts: str, amount: str, cap: float, seconds: int = 60) -> DataFrame:
    """Adds window_sum, blocked (the trailing sum exceeds the cap) and wait_s (until the window's oldest row leaves it)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = rate_window(df, partition, ts, amount, seconds).withColumn("_us", us)
    oldest = F.min("_us").over(W.partitionBy(*partition).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0))
    d = d.withColumn("blocked", F.round("window_sum", 4) > cap)
    return d.withColumn("wait_s", F.when(F.col("blocked"), F.round((seconds * 1_000_000 - (F.col("_us") - oldest)) / 1e6, 6)).otherwise(0.0)).drop("_us")
