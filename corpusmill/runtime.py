"""Session plumbing shared by operators: shipped code, shared scratch tables, blob files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of any cluster (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill-"), "corpusmill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._corpusmill_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = getattr(spark.sparkContext, "_corpusmill_scratch", None)
        if not d:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="corpusmill-scratch-")
            spark.sparkContext._corpusmill_scratch = d
    return d.rstrip("/")


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables that this session's operators have written; results that read them are then void."""
    for s in getattr(spark.sparkContext, "_corpusmill_used", []):
        s.drop()
    spark.sparkContext._corpusmill_used = []


class Scratch:
    """Intermediate tables of one run in the shared folder.

    A table written here cuts lineage the way checkpoint() does: a lost executor
    costs the re-read of one file split, not the recomputation of the job.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
        used = getattr(spark.sparkContext, "_corpusmill_used", [])
        spark.sparkContext._corpusmill_used = [*used, self]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        p = f"{self.path}/{name}"
        df.write.parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, name: str = "") -> None:
        """Remove one table, or without a name all of them."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def blobs(self, df: DataFrame, name: str, column: str = "blob") -> str:
        """Write each row's binary to the partition's file with Spark's commit protocol.

        One row per partition makes one raw file per blob; a newline follows each blob.
        """
        p = f"{self.path}/{name}"
        df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\n").text(p)
        return p


def input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Size that the optimizer's statistics give for df (compressed bytes for a file scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: From here on (1 PiB) the optimizer's size is taken for its stand-in for "unknown" (rows made in the session, joins).
UNKNOWN_BYTES = 1 << 50


def measured_bytes(df: DataFrame) -> int:
    """Bytes of df's texts and binaries and 8 for any other value, by one pass over the rows."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    size = F.lit(0).cast("long")
    for f in flat.schema:
        wide = f.dataType.simpleString() in ("string", "binary")
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if wide else F.lit(8))
    return flat.agg(F.sum(size)).first()[0] or 0


def slices(spark: SparkSession, df: DataFrame, bytes_per_slice: int, least: int = 1) -> int:
    """A partition count that follows the input's size."""
    size = input_bytes(spark, df)
    if size >= UNKNOWN_BYTES:
        size = measured_bytes(df)
    return max(least, -(-size // bytes_per_slice))
