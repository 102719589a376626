"""Exact cosine links between vectors by cover trees and dual traversal.

Unit vectors have cosine c exactly at distance sqrt(2 - 2c), so a threshold on the
cosine is a radius. The upper levels of the tree are tables: a cell with too many
members is dealt to centres taken farthest first from a sample of it, until the rest of
the sample lies within half its radius or the fan-out is reached; every cell knows its
centre and covering radius as measured. A traversal over pairs of cells, level by level,
drops a pair when its centres are farther apart than both covering radii and the radius,
and of a pair that stays, members farther from the other centre than its covering radius
and the radius. What is left are pairs of bounded cells; each is finished in one task by a
cover tree of nested levels with halving radii and a dual traversal with the same bound.
Nothing is parted where distances say nothing: among vectors without neighbours in many
dimensions (all about 90 degrees apart) every cell meets every other, and of N near but
unequal vectors all pairs are compared, so the work there grows with the square of N.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.runtime import Scratch, ship

_GUARD = 1e-9


class Node:
    """A centre (an index into the vectors), its covering radius, its children or, in a leaf, its members."""

    __slots__ = ("center", "radius", "children", "members")

    def __init__(self, center: int, radius: float, children: list, members: np.ndarray):
        self.center, self.radius, self.children, self.members = center, radius, children, members


def build(x: np.ndarray, members: np.ndarray, cover: float = 2.0, leaf: int = 32) -> Node:
    """The cover tree of unit vectors x[members]: children cover the node within half its cover."""
    center = int(members[0])
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[members] @ x[center])))
    radius = float(d.max())
    if len(members) <= leaf or radius <= _GUARD:
        return Node(center, radius, [], members)
    while cover / 2 >= radius:
        cover /= 2
    cover /= 2
    rest, children = members, []
    while len(rest):
        near = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[rest[0]]))) <= cover
        near[0] = True
        children.append(build(x, rest[near], cover, leaf))
        rest = rest[~near]
    return Node(center, radius, children, members)


def dual_links(x: np.ndarray, a: Node, b: Node, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine at or above the threshold, i below a and j below b; a is b: i < j once."""
    t = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    left, right, stack = [], [], [(a, b)]
    centers = lambda nodes: np.array([n.center for n in nodes])
    radii = lambda nodes: np.array([n.radius for n in nodes])
    alone = lambda nodes: np.array([len(n.members) == 1 for n in nodes])
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            g = x[p.members] @ x[q.members].T >= cosine
            if p is q:
                g = np.triu(g, 1)
            i, j = np.nonzero(g)
            left.append(p.members[i])
            right.append(q.members[j])
            continue
        ps, qs = p.children or [p], q.children or [q]
        u, v, rq, single = centers(ps), centers(qs), radii(qs), alone(qs)
        rp, single_p, step = radii(ps), alone(ps), max(1, (1 << 20) // len(qs))
        for at in range(0, len(ps), step):  # bounded parts of the table of centres
            rows = slice(at, at + step)
            dots = x[u[rows]] @ x[v].T
            near = np.sqrt(np.maximum(0.0, 2 - 2 * dots)) <= rp[rows, None] + rq[None, :] + t
            if p is q:
                near &= np.arange(len(qs))[None, :] >= np.arange(at, min(at + step, len(ps)))[:, None]
            both = single_p[rows, None] & single[None, :]
            i, j = np.nonzero(near & both & (dots >= cosine))
            ok = u[i + at] != v[j]
            left.append(u[i[ok] + at])
            right.append(v[j[ok]])
            stack += [(ps[m + at], qs[n]) for m, n in zip(*np.nonzero(near & ~both))]
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n indices the smallest one connected to it by the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _finish(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        from corpusmill.llm.covertree import _matrix, build, dual_links, smallest_reachable

        rep, n, side = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "n", "side"))
        x = _matrix(table.column("v"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if table.column("a")[0] == table.column("b")[0]:
            a = build(x, first)
            i, j = dual_links(x, a, a, cosine)
        elif len(first) and len(second):
            i, j = dual_links(x, build(x, first), build(x, second), cosine)
        else:  # the other side has no member that can have a link
            i = j = np.zeros(0, np.int64)
        count = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        low = smallest_reachable(len(rep), i, j)
        at = np.flatnonzero(count)
        return pa.table({"rep": rep[at], "links": count[at].astype(np.int64), "to": rep[low[at]]})

    return run


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, cell: int = 8192, pivots: int = 16) -> DataFrame:
    """(vec_id, n_links, component_id, kept): direct links and smallest reachable id for every row.

    Vectors are compared when their labels are equal and not null. Equal vectors of a
    label are one class from the start (combined map-side), with its size, so copies
    cost one member. cell bounds a leaf cell, hence a task, pivots the cells that one is
    dealt to; no bound drops anything. Vectors may be arrays of floats, doubles or other
    numbers (taken as doubles); distances are in double precision.
    Vectors that are null, zero or hold null or non-finite components, and rows with a
    null label or id, link with nothing; repeated ids are counted as separate vectors; an empty table
    gives an empty result; vectors of different lengths never link; other columns are
    not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "covertree")
    v = F.col("v")
    kind = vectors.select(F.col(vector_col)).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    ok = v.isNotNull() & (F.size(v) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    keyed = src.select("vec_id", "label", F.when(ok, F.xxhash64("label", "v")).alias("k1"), F.when(ok, F.xxhash64(F.lit(29), "v")).alias("k2"), "v")
    classes = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # a representative stands for one class: ids that are repeated with other vectors are told apart by the key
    base = scratch.table(classes.select("k1", "k2", "rep", "n", F.concat_ws("/", "label", F.size("v").cast("string")).alias("cell"), "v"), "classes")
    members = base.select("k1", "n", "cell", "v")
    nodes, level = None, 0
    done = []
    while True:
        sizes = members.groupBy("cell").agg(F.count("*").alias("size"))
        big = sizes.filter(F.col("size") > cell).select("cell")
        done.append(members.join(big, "cell", "left_anti"))
        if big.limit(1).count() == 0:
            break
        split = members.join(big, "cell", "left_semi")
        chosen = _pivots(split, pivots, level)
        step = scratch.table(split.join(chosen, "cell").mapInArrow(_assign, f"k1 long, n long, cell string, v {kind}, dist double, center {kind}, parent string"), f"level-{level}")
        found = step.groupBy("cell", "parent").agg(F.max("dist").alias("radius"), F.first("center").alias("center"))
        nodes = found.withColumn("level", F.lit(level)) if nodes is None else nodes.unionByName(found.withColumn("level", F.lit(level)))
        members, level = step.select("k1", "n", "cell", "v"), level + 1
    leaves = done[0]
    for d in done[1:]:
        leaves = leaves.unionByName(d)
    leaves = scratch.table(leaves, "leaves")
    pairs = leaves.select("cell").distinct().select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    t = math.sqrt(2 - 2 * cosine)
    if nodes is not None:
        nodes = scratch.table(nodes, "nodes")
        pairs = scratch.table(pairs.unionByName(_traverse(nodes, level, t, scratch)), "pairs")
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")), F.struct(F.lit(1).alias("side"), F.col("b").alias("cell"))))).alias("s")).select("a", "b", "s.side", "s.cell")
    work = leaves.join(sides, "cell")
    if nodes is not None:
        # a member farther from the other cell's centre than its covering radius and t has no link there
        other = nodes.select(F.col("cell").alias("other"), "radius", "center")
        work = work.withColumn("other", F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))).join(other, "other", "left")
        work = work.filter((F.col("a") == F.col("b")) | (_distance(F.col("v"), F.col("center")) <= F.col("radius") + t + 1e-6))
    work = work.select("a", "b", "side", F.col("k1").alias("rep"), "n", "v")
    found = scratch.table(work.groupBy("a", "b").applyInArrow(_finish(cosine), "rep long, links long, to long"), "links")
    ids = base.select(F.col("k1").alias("rep"), F.col("rep").alias("id"))
    ends = found.filter("rep <> to").select("rep", "to").distinct()
    named = ends.join(ids, "rep").select("to", F.col("id").alias("a")).join(ids, F.col("to") == ids["rep"]).select("a", F.col("id").alias("b"))
    comps = components(named, scratch)
    counts = found.groupBy("rep").agg(F.sum("links").alias("more"))
    out = base.select("k1", "k2", "n", F.col("rep").alias("id")).join(counts, F.col("k1") == F.col("rep"), "left").join(comps, F.col("id") == F.col("node"), "left")
    out = out.select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    keyed = keyed.select("vec_id", "k1", "k2")
    linked = keyed.filter("k1 is not null").join(out, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _distance(a: Column, b: Column) -> Column:
    """Distance of two vectors' directions."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))))


def _pivots(split: DataFrame, pivots: int, level: int, sample: int = 8) -> DataFrame:
    """(cell, p): at most pivots centres of each cell, taken farthest first from a hash sample of pivots * sample members."""
    h = F.xxhash64("k1", F.lit(level))
    slot = F.pmod(h, F.lit(pivots * sample)).alias("slot")
    one = split.select("cell", slot, F.struct(h.alias("h"), F.col("v")).alias("s")).groupBy("cell", "slot").agg(F.min("s").alias("s"))
    some = one.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusmill.llm.covertree import _matrix, centers

        for b in batches:
            kept = [p.values.take(pa.array(centers(_matrix(p.values), pivots))) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.to_pylist() for k in kept], b.column(1).type)], names=["cell", "p"])

    return some.mapInArrow(run, some.schema)


def centers(x: np.ndarray, most: int) -> list[int]:
    """Rows of x farthest first, from the first row on, until all lie within half the first one's radius or there are most."""
    out = [0]
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[0])))
    half = float(d.max()) / 2
    while len(out) < most and (far := int(d.argmax())) not in out and (d[far] > half or len(out) < 2):
        out.append(far)
        d = np.minimum(d, np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[far]))))
    return out


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal members (cell, k1, n, v, p) to the nearest of their cell's pivots p."""
    from corpusmill.llm.covertree import _matrix

    for b in batches:
        cells, k1, n, v = (b.column(b.schema.get_field_index(c)) for c in ("cell", "k1", "n", "v"))
        names, x = np.array(cells.to_pylist(), object), _matrix(v)
        into, dist, center = [None] * len(names), np.zeros(len(names)), [None] * len(names)
        for c in dict.fromkeys(names):
            at = np.flatnonzero(names == c)
            p = b.column(b.schema.get_field_index("p"))[int(at[0])]
            vectors = p.as_py()
            y = np.array(vectors, np.float64)
            y /= np.sqrt((y * y).sum(1))[:, None]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[at] @ y.T)))
            k = d.argmin(1)
            dist[at] = d[np.arange(len(at)), k]
            for i, m in zip(at.tolist(), k.tolist()):
                into[i], center[i] = f"{c}.{m}", vectors[m]
        yield pa.RecordBatch.from_arrays([k1, n, pa.array(into, pa.string()), v, pa.array(dist), pa.array(center, v.type), cells], names=["k1", "n", "cell", "v", "dist", "center", "parent"])


def _traverse(nodes: DataFrame, levels: int, t: float, scratch: Scratch) -> DataFrame:
    """Pairs of different leaf cells that the covering-radius bound cannot part."""

    node = nodes.select("cell", "parent", "radius", "center")
    inner = nodes.select(F.col("parent").alias("cell")).distinct().withColumn("inner", F.lit(True))
    node = scratch.table(node.join(inner, "cell", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "tree")
    roots = nodes.filter("level = 0").select("parent").distinct()
    pairs, out = roots.select(F.col("parent").alias("a"), F.col("parent").alias("b")), None
    # a leaf met by an inner cell stays and waits while the other side goes down
    keep = node.select(F.col("cell").alias("parent"), "cell", "radius", "center", "inner").filter(~F.col("inner"))
    child = node.select("parent", "cell", "radius", "center", "inner").unionByName(keep)
    for level in range(levels):
        a, b = child.alias("x"), child.alias("y")
        both = pairs.join(a, F.col("a") == F.col("x.parent")).join(b, F.col("b") == F.col("y.parent")).filter(F.col("x.cell") <= F.col("y.cell"))
        near = both.filter(_distance(F.col("x.center"), F.col("y.center")) <= F.col("x.radius") + F.col("y.radius") + F.lit(t + 1e-6))
        met = scratch.table(near.select(F.col("x.cell").alias("a"), F.col("y.cell").alias("b"), F.col("x.inner").alias("ia"), F.col("y.inner").alias("ib")).distinct(), f"pairs-{level}")
        leaf = met.filter("not ia and not ib and a <> b").select("a", "b")
        out = leaf if out is None else out.unionByName(leaf)
        pairs = met.filter("ia or ib").select("a", "b")
    return out.distinct()
