"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import Scratch


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Star edges (node, smallest node of its group) that connect what pairs connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up)]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        stars = forest(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in stars], pa.int64()), pa.array([x[1] for x in stars], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", contracted: bool = False) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    Each step is one aggregation (combined map-side) and one equi-join of which
    adaptive execution may split hot keys, then a written table that cuts lineage.
    The number of steps grows with the logarithm of a component's diameter. Null
    ends and self links are ignored; an empty table gives an empty result. Links that
    their maker has contracted per batch pass through no further Python worker.
    """
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    e = scratch.table((e if contracted else e.mapInArrow(_contract, "a long, b long")).distinct(), "stars-0")
    step = 0
    while True:
        # large star: every larger neighbour of u links to the smallest of u and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node and its smaller neighbours link to the smallest of them
        down = large.filter("a > b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p")).select("p.a", "p.b").filter("a > b").distinct()
        step += 1
        new = scratch.table(small, f"stars-{step}")
        # done when every node has one link and no target has a link of its own
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        old = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(f"stars-{step - 1}")
        e = new
        if state == old:
            break
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(e.groupBy("b").agg(F.min("b").alias("component")).select("b", "component"))
