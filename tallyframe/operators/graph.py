"""Connected components of an edge table, by alternating large and small stars.

Each round hangs every node on the least node it sees, from the larger and then
from the smaller side; the number of rounds grows with the logarithm of the
number of nodes. A node with very many edges costs one partially aggregated
minimum and one join, which adaptive execution can split. Every round is written
to the shared folder, so no round is computed twice and lost executors cost one
round at most. Once few edges are left, a task finishes them: rounds over small
tables cost the driver a record for each of their many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Edges that one task holds and finishes, 16 bytes each.
FEW = 1 << 18


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v for every edge, once."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .groupBy("u", "v")
        .agg(F.lit(1).alias("one"))
        .select("u", "v")
    )


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A written table, not an aggregate, stands below the join: so its large partitions can be split.
    least = materialize(least, "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u")
    return hung.select("u", F.col("m").alias("v")).union(hung.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _mark(e: DataFrame):
    # Wrapping 64-bit sums of hashes, folded so that they don't overflow.
    return tuple(
        e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31))), F.bit_xor(F.xxhash64("u", "v"))).first()
    )


def _finished(batches):
    """(node, root) for every node of all edges that come."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while ((further := root[root]) != root).any():
            root = further
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v): root is the least node reachable.

    Self-loops, repeated and reversed edges change nothing; an empty table gives
    an empty result; edges with a null end are ignored.
    """
    e = materialize(_star(edges.select("u", "v").dropna()), "edges")
    kind, mark = dict(e.dtypes)["u"], _mark(e)
    while mark[0]:
        if mark[0] <= FEW and kind in ("int", "bigint"):
            return materialize(e.coalesce(1).mapInArrow(_finished, f"node {kind}, root {kind}"), "roots")
        e = materialize(_star(_small(_star(_large(e)))), "edges")
        if (now := _mark(e)) == mark:
            break
        mark = now
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def cycles(edges: DataFrame) -> DataFrame:
    """Edges (child, parent) that lie on or between cycles: what is left after leaves are peeled again and again.

    Empty for an acyclic graph. A round takes off every node without children;
    the number of rounds is the length of the longest path.
    """
    left = materialize(edges.select("child", "parent").dropDuplicates(), "peel")
    n = left.count()
    while n:
        # A child that is nobody's parent is a leaf.
        left = materialize(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "peel")
        if (now := left.count()) == n:
            break
        n = now
    return left


def terminals(aliases: DataFrame) -> DataFrame:
    """(source, target) with every chain followed to its end, by pointer jumping."""
    at = materialize(aliases.select("source", "target"), "alias")
    while True:
        following = at.select(F.col("source").alias("target"), F.col("target").alias("further"))
        moved = materialize(at.join(following, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), "alias")
        at = moved.select("source", "target")
        if moved.where("moved").isEmpty():
            return at
