"""Candidate selection, de-duplication, sampling and splitting.

Order matters in these operators, so each takes a position column as its last
tie-break; results do not depend on the physical order of rows. Random choices come
from md5 of seed and key, so they are the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (one row by construction, so its broadcast is bounded)."""
    return df.crossJoin(F.broadcast(stats))


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_norm with the sample standard deviation; a constant column gives null."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = with_one_row(df, stats)
    for c in columns:
        out = out.withColumn(f"{c}_norm", F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def argmax(df: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """The row of each group with the largest score; NaN and null scores and null keys never win; ties to the first.

    One aggregation with map-side partial winners, so a group is never gathered (the plan
    is a sort aggregate, as a struct has no mutable hash buffer).
    """
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for k in keys:
        ok = ok.filter(F.col(k).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    best = ok.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(position)).alias("p"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def rescale(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """Shift the minimum to 0 and scale the mean to 1; a constant column becomes null."""
    out = with_one_row(df, df.agg(F.min(column).alias("_min"), F.avg(column).alias("_avg")))
    v = F.try_divide(F.col(column) - F.col("_min"), F.nullif(F.col("_avg") - F.col("_min"), F.lit(0.0)))
    return out.withColumn(column, F.round(v, digits) if digits is not None else v).drop("_min", "_avg")


def select_candidates(df: DataFrame, key: str, position: str, content: str, style: str, content_weight: float = 0.6, digits: int = 6) -> DataFrame:
    """Winners by z-scored convex combination, with confidence rescaled to minimum 0 and mean 1."""
    d = zscores(df.na.drop(subset=[content, style]), [content, style])
    d = d.withColumn("confidence", F.round(F.col(f"{content}_norm") * content_weight + F.col(f"{style}_norm") * (1 - content_weight), digits)).drop(f"{content}_norm", f"{style}_norm")
    return rescale(argmax(d, [key], "confidence", position), "confidence", digits)


def keep_first(df: DataFrame, keys: list[Column], position: str) -> DataFrame:
    """The first row by position of each key; nulls are one key. Winners are combined map-side."""
    names = [f"_k{i}" for i in range(len(keys))]
    d = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    return d.groupBy(*names).agg(F.min_by(F.struct(*df.columns), F.col(position)).alias("_r")).select("_r.*")


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows with column >= minimum. A minimum of 0 or less keeps all rows, nulls too; a larger one drops nulls."""
    return df.filter(F.col(column) >= minimum) if minimum > 0 else df


def positions(df: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Adds pos, the 0-based rank by a long key.

    Ranks come from counts of key ranges and of ranges of those, so a task orders one range,
    or the counts of width ranges; the last step orders one row for width * width keys.
    """
    b = df.withColumn("_b", F.floor(F.col(key) / width))
    counts = b.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_t", F.floor(F.col("_b") / width))
    running = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    tops = counts.groupBy("_t").agg(F.sum("_c").alias("_n"))
    tops = tops.select("_t", (F.sum("_n").over(running(W.orderBy("_t"))) - F.col("_n")).alias("_above"))
    within = counts.withColumn("_in", F.sum("_c").over(running(W.partitionBy("_t").orderBy("_b"))) - F.col("_c"))
    before = within.join(tops, "_t").select("_b", (F.col("_above") + F.col("_in")).alias("_before"))
    return b.join(before, "_b").withColumn("pos", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_before")


def drop_first(df: DataFrame, key: str, k: int) -> DataFrame:
    """All rows but the k first by a long key."""
    return positions(df, key).filter(F.col("pos") >= k).select(df.columns)


def uniform(seed: int | Column, key: Column) -> Column:
    """A number in [0, 1) from md5 of seed and key."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.md5(F.concat_ws("|", s, key.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_sample(df: DataFrame, weight: Column, size: int, key: str, seed: int = 42) -> DataFrame:
    """size rows without replacement, each draw in proportion to the weights left (exponential keys, one top-k)."""
    e = F.round(-F.ln(F.greatest(uniform(seed, F.col(key)), F.lit(1e-12))) / F.greatest(weight, F.lit(1e-8)), 9)
    return df.withColumn("_e", e).orderBy("_e", key).limit(size).drop("_e")


def hash_sample(df: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(size).drop("_h")


def hash_rank(df: DataFrame, key: str, seed: int | Column, partition: list[str], bits: int = 16) -> DataFrame:
    """Adds _r, the rank (1..n) by md5 within each partition, and _n, its size, without sorting a partition whole.

    Rows are bucketed by the hash's leading bits; a bucket's rank offset is a running sum
    over bucket counts, and only buckets are sorted.
    """
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    d = df.withColumn("_h", F.md5(F.concat_ws("|", s, F.col(key).cast("string")))).withColumn("_b", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), 32 - bits))
    counts = d.groupBy(*partition, "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*partition)
    counts = counts.select(*[F.col(p).alias(f"_p_{p}") for p in partition], F.col("_b").alias("_b2"), (F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    on = F.col("_b") == F.col("_b2")
    for p in partition:
        on = on & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    d = d.join(counts, on)
    return d.withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy(*partition, "_b").orderBy("_h", key))).drop("_h", "_b", "_b2", "_before", *[f"_p_{p}" for p in partition])


def split(df: DataFrame, key: str, seed: int | Column = 42, partition: list[str] | None = None, rule: str = "floor", names: tuple[str, str, str] = ("train", "val", "test")) -> DataFrame:
    """80/10/10 by shuffled position. floor: cuts at int(.8n) and int(.9n); ceil: ceil(.2n) set aside, then ceil of half of it last."""
    d = hash_rank(df, key, seed, partition or [])
    n, r = F.col("_n"), F.col("_r")
    if rule == "floor":
        a, b = F.floor(n * 0.8), F.floor(n * 0.9)
    else:
        rest = F.ceil(n * 0.2)
        a, b = n - rest, n - F.ceil(rest * 0.5)
    return d.withColumn("split", F.when(r <= a, names[0]).when(r <= b, names[1]).otherwise(names[2])).drop("_r", "_n")


def combine_splits(df: DataFrame, key: str, seed: int = 42, column: str = "split") -> DataFrame:
    """Rows split by source, put together for each split and shuffled anew with seed + 2: adds position, from 1."""
    return hash_rank(df, key, seed + 2, [column]).withColumnRenamed("_r", "position").drop("_n")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done; repeats and null keys survive. Spark broadcasts done only below its size threshold."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def null_safe_semi(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = None
    other = b.select([F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        on = c if on is None else on & c
    return a.join(other, on, how)
