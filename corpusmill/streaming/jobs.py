"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.selection import positions, remaining


def append_new(spark: SparkSession, source: DataFrame, sink: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Process each file's rows whose key the sink does not hold yet, once; restartable from the checkpoint.

    A batch that is run again overwrites its own folder of the sink, so a lost driver
    leaves no repeats.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = _before(df.sparkSession, sink, number, df.schema)
        new = remaining(df, done, key) if done is not None else df
        work(new.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark: SparkSession, sink: str, number: int, schema) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(sink)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(schema.add("batch", "long")).parquet(sink).filter(F.col("batch") < number).drop("batch")


def windowed_sums(source: DataFrame, ts: str, amount: str, width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sums by event-time window with a watermark (or the same over a batch)."""
    d = source.withColumn(ts, F.col(ts).cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return d.groupBy(w.alias("w")).agg(F.sum(amount).alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def unseen(source: DataFrame, key: str, ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """First row of each key; with ts the state is bounded by the watermark."""
    return source.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else source.dropDuplicates([key])


def flushes(df: DataFrame, position: str, size: int = 6) -> DataFrame:
    """Adds flush, from 1: rows in order of a long position go out size at a time, the last ones as a part of a flush."""
    return positions(df, position).withColumn("flush", F.floor(F.col("pos") / size) + 1).drop("pos")


def route_errors(df: DataFrame, parsed: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, dead letters): a row fails alone, never its batch."""
    return df.filter(F.col(parsed).isNotNull()), df.filter(F.col(parsed).isNull()).select(F.col(raw).alias("line"), F.lit("unparsed").alias("reason"))
