"""Sparse overlaps of regions: pairs, similarity, association and part-of graphs.

A region is a set of weighted entities seen in one view, with a concept. Pairs come
from an equi-join on (concept, entity), so only regions that share something meet.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize, release
from .graph import components

#: Rows of pairs that a round makes, so that they fit the disk beside the tables; hits asked for beyond what may be missing.
ROUND_PAIRS, HITS = 40_000_000, 10


def totals(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.sum("weight").alias("weight"), F.count("*").alias("size"))


def pairs(regions: DataFrame, same_concept: bool = True, other_view: bool = True) -> DataFrame:
    """(a, b, shared, low): regions a < b with shared entities and the sum of their smaller weights."""
    left = regions.select("entity", F.col("concept").alias("ca"), F.col("region").alias("a"), F.col("view").alias("va"), F.col("weight").alias("wa"))
    right = regions.select("entity", F.col("concept").alias("cb"), F.col("region").alias("b"), F.col("view").alias("vb"), F.col("weight").alias("wb"))
    meet = (left["entity"] == right["entity"]) & (F.col("a") < F.col("b"))
    if same_concept:
        meet = meet & (F.col("ca") == F.col("cb"))
    if other_view:
        meet = meet & (F.col("va") != F.col("vb"))
    return left.join(right, meet).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.least("wa", "wb")).alias("low"))


def similarities(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds iou, both containments, and the weighted Jaccard similarity sum(min) / sum(max)."""
    t = totals(regions)
    a = t.select(F.col("region").alias("a"), F.col("weight").alias("ta"), F.col("size").alias("na"))
    b = t.select(F.col("region").alias("b"), F.col("weight").alias("tb"), F.col("size").alias("nb"))
    j = found.join(a, "a").join(b, "b")
    return j.select(
        "a",
        "b",
        "shared",
        (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("iou"),
        (F.col("shared") / F.col("na")).alias("in_a"),
        (F.col("shared") / F.col("nb")).alias("in_b"),
        (F.col("low") / (F.col("ta") + F.col("tb") - F.col("low"))).alias("jaccard"),
        (F.col("low") / F.least("ta", "tb")).alias("weighted_containment"),
    )


def clusters(regions: DataFrame, similar: DataFrame, threshold: float) -> DataFrame:
    """(region, cluster): regions joined by chains of pairs at or above the threshold; cluster is the least region."""
    edges = similar.where(F.round("jaccard", 9) >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges).select(F.col("node").alias("region"), F.col("root").alias("cluster"))
    return regions.select("region").distinct().join(roots, "region", "left").select("region", F.coalesce("cluster", "region").alias("cluster"))


def classified(similar: DataFrame, concepts: DataFrame, duplicate: float = 0.8, child: float = 0.6, parent: float = 0.3) -> DataFrame:
    """Each overlapping pair as merge (same concept, mutual), part_of (from, into) or noise."""
    a, b = (concepts.select(F.col("region").alias(n), F.col("concept").alias(f"c{n}"), F.col("size").alias(f"n{n}")) for n in "ab")
    j = similar.join(a, "a").join(b, "b")
    same = F.col("ca") == F.col("cb")
    merge = same & (F.col("in_a") >= duplicate) & (F.col("in_b") >= duplicate)
    a_in_b = ~same & (F.col("in_a") >= child) & (F.col("in_b") <= parent)
    b_in_a = ~same & (F.col("in_b") >= child) & (F.col("in_a") <= parent)
    # The smaller region goes into the larger; of equal ones the larger id goes.
    a_smaller = F.col("na") < F.col("nb")
    first = F.when(merge, F.when(a_smaller, F.col("a")).otherwise(F.col("b"))).when(a_in_b, F.col("a")).when(b_in_a, F.col("b")).otherwise(F.col("a"))
    kind = F.when(merge, "merge").when(a_in_b | b_in_a, "part_of").otherwise("noise")
    return j.select(kind.alias("kind"), first.alias("source"), F.when(first == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target"), "shared")


def geometry(support: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Weighted centroid and bounding box of each key's entities."""
    j = support.join(points, "entity")
    centre = [(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"c{c}") for c in "xyz"]
    return j.groupBy(key).agg(F.count("*").alias("size"), *centre, *(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"))


def mutual_best(similar: DataFrame, views: DataFrame, score: str) -> DataFrame:
    """Pairs that are each other's best in the other's view; smaller ids first on ties."""
    a, b = (views.select(F.col("region").alias(n), F.col("view").alias(f"v{n}")) for n in "ab")
    j = similar.join(a, "a").join(b, "b").withColumn("s", F.round(score, 9))
    best_b = F.row_number().over(Window.partitionBy("a", "vb").orderBy(F.desc("s"), "b"))
    best_a = F.row_number().over(Window.partitionBy("b", "va").orderBy(F.desc("s"), "a"))
    return j.withColumn("rb", best_b).withColumn("ra", best_a).where("ra = 1 and rb = 1").select("a", "b", "s")


def disjoint_in_view(regions: DataFrame, max_iou: float) -> DataFrame:
    """Pairs of one view and concept that overlap at most ``max_iou``, also those that share nothing."""
    own = regions.select("region", "view", "concept").distinct()
    other = own.withColumnRenamed("region", "b")
    all_pairs = own.withColumnRenamed("region", "a").join(other, ["view", "concept"]).where("a < b")
    meet = pairs(regions, True, False)
    t = totals(regions)
    j = all_pairs.join(meet.select("a", "b", "shared"), ["a", "b"], "left")
    j = j.join(t.select(F.col("region").alias("a"), F.col("size").alias("na")), "a").join(t.select(F.col("region").alias("b"), F.col("size").alias("nb")), "b")
    shared = F.coalesce("shared", F.lit(0))
    return j.where(shared / (F.col("na") + F.col("nb") - shared) <= max_iou).select("a", "b", "view", "concept")


def _in_rounds(left: DataFrame, key: str, pairs: int, found, name: str) -> DataFrame:
    """``found`` of every part of ``left``, one after the other; what a round shuffles is let go before the next."""
    rounds, out = max(1, math.ceil(pairs / ROUND_PAIRS)), []
    for k in range(rounds):
        out.append(materialize(found(left.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k)), name))
        if rounds > 1:
            release(left.sparkSession)
    return reduce(DataFrame.union, out)


def alike(regions: DataFrame, threshold: float) -> DataFrame:
    """(part, a, b): regions a < b of a concept whose weighted Jaccard similarity reaches the threshold."""
    left = regions.select(F.col("concept").alias("part"), "entity", F.col("region").alias("a"), F.col("weight").alias("wa"))
    right = regions.select(F.col("concept").alias("part"), "entity", F.col("region").alias("b"), F.col("weight").alias("wb"))
    t = totals(regions)
    ta, tb = (t.select(F.col("region").alias(n), F.col("weight").alias(f"t{n}")) for n in "ab")
    likeness = F.col("low") / (F.col("ta") + F.col("tb") - F.col("low"))

    def found(some):
        low = some.join(right, ["part", "entity"]).where("a < b").groupBy("part", "a", "b").agg(F.sum(F.least("wa", "wb")).alias("low"))
        return low.join(ta, "a").join(tb, "b").where(likeness >= threshold).select("part", "a", "b")

    n = left.groupBy("part", "entity").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    return _in_rounds(left, "a", int(n or 0), found, "alike")


def contained(regions: DataFrame, share: float) -> DataFrame:
    """The regions of whose entities at least the share lie in one larger region.

    Such a region misses few of its entities there, so of its rarest ones, a few more than it may miss, the larger region
    has those few. Only regions that meet so often are compared whole; frequent entities bring no regions together.
    """
    sized = regions.select("region", "entity").join(regions.groupBy("region").agg(F.count("*").alias("size")), "region")
    often = regions.groupBy("entity").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("often", "entity"))
    missed = F.floor(F.col("na") * F.lit(1 - share) + 1e-6)
    rows = sized.join(often, "entity").select(F.col("region").alias("a"), "entity", F.col("size").alias("na"), "often").withColumn("rank", rank)
    rare = materialize(rows.where(F.col("rank") <= missed + HITS).select("a", "entity", "na", "often"), "rare")
    larger = materialize(sized.select(F.col("region").alias("b"), "entity", F.col("size").alias("nb")), "larger")

    def found(some):
        hits = some.join(larger, "entity").where("na < nb").groupBy("a", "b", "na").agg(F.count("*").alias("hits"))
        return hits.where(F.col("hits") >= F.least(F.col("na"), missed + HITS) - missed).select("a", "b", "na")

    n = rare.agg(F.sum("often")).first()[0]
    met = _in_rounds(rare, "a", int(n or 0), found, "met")
    shared = met.join(regions.select(F.col("region").alias("a"), "entity"), "a").join(larger.select("b", "entity"), ["b", "entity"])
    whole = shared.groupBy("a", "b", "na").agg(F.count("*").alias("shared"))
    return whole.where(F.col("shared") / F.col("na") >= share).select(F.col("a").alias("region")).distinct()
