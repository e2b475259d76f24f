"""Order-dependent selections; held against step-by-step references in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import greedy as op
from ..operators import overlap as ov
from ..sources.encodings import cameras, regions, table
from ..storage import materialize
from .overlap import _similar
from .registry import query
from .stats import _boxes


@query("GR1 JN12", None)
def cannot_link_clusters(spark, d):
    rows, sim = _similar(spark, d)
    concepts = rows.select("region", "concept").distinct()
    edges = sim.join(concepts.withColumnRenamed("region", "a"), "a").select("concept", "a", "b", "shared", "jaccard")
    return op.constrained_clusters(edges, ov.disjoint_in_view(rows, 0.15), 0.1)


@query("GR6 TOP18", None)
def disjoint_view_components(spark, d):
    rows, sim = _similar(spark, d)
    views = rows.select("region", "view").distinct()
    a, b = (views.select(F.col("region").alias(n), F.col("view").alias(f"v{n}")) for n in "ab")
    edges = sim.where("jaccard >= 0.1").join(a, "a").join(b, "b").select(F.lit(1).alias("part"), "a", "b", "va", "vb", F.round("jaccard", 9).alias("score"))
    return op.disjoint_components(edges)


@query("GR11 X22 SET1", None)
def sequential_clusters(spark, d):
    rows = regions(spark, d).groupBy("concept", "region").agg(F.round(F.max("weight"), 6).alias("score"), F.sort_array(F.collect_list("entity")).alias("entities"))
    return op.sequential_clusters(rows, 0.25, 0.4)


@query("TOP5 TOP4 TOP19 SRC11", None)
def suppressed_boxes(spark, d):
    k = F.col("k")
    boxes = _boxes(spark, d).select(
        F.pmod(k, F.lit(5)).cast("int").alias("frame"), F.pmod(k, F.lit(2)).cast("int").alias("class_id"), k.alias("box"), (F.pmod(k * 31, F.lit(97)) / 97).alias("score"), "x0", "y0", "x1", "y1"
    )
    return op.suppressed(boxes, 100.0, 200000.0, 0.3, 8)


@query("TOP4", None)
def contained_masks(spark, d):
    """Masks that lie to nine tenths in a larger one go, the rest of a concept is suppressed greedily by overlap."""
    rows = materialize(regions(spark, d).select("region", "concept", "entity", "weight"), "regions")
    size = ov.totals(rows).select("region", "size")
    concept = rows.select("region", F.col("concept").alias("part")).distinct()
    left = size.join(ov.contained(rows, 0.9), "region", "left_anti").join(concept, "region")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "region"))
    nodes = left.select("part", F.col("region").alias("node"), place.alias("place"), "size")
    return nodes.join(op.first_come(nodes, ov.alike(rows, 0.2)), ["part", "node"]).select(F.col("node").alias("region"), "part", "size")


@query("TOP7 MTH11", None)
def farthest_cameras(spark, d):
    return op.farthest(cameras(spark, d), [1, 2], 12, 10.0)


def _covered(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("observer")).agg(F.countDistinct("l_partkey").alias("n"))
    parts = table(spark, d, "part").agg(F.count("*").alias("parts"))
    return cameras(spark, d).join(n.crossJoin(F.broadcast(parts)), "observer").withColumn("covered", F.col("n") / F.col("parts")).drop("n", "parts")


@query("TOP8 MTH6 X30", None)
def low_coverage_cameras(spark, d):
    return op.low_coverage(_covered(spark, d), [1], 8, 0.3, 0.8, 0.2, 10.0)


@query("TOP15 MTH23", None)
def separated_cameras(spark, d):
    return op.separated(cameras(spark, d), 1, (0.0, 50.0, 10.0), 10.0, 8.0, 6)


@query("TOP16 CMP15 CMP17 STR13", None)
def prompt_knapsack(spark, d):
    items = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("item")).agg(F.sum("p_size").alias("size"))
    items = items.withColumn("thing", F.length("item") % 2 == 0).withColumn("words", F.size(F.split("item", " ")))
    return op.within_budget(items, 60)


@query("GR25 X19", None)
def takeover_sequence(spark, d):
    """Candidates by rising risk take what no earlier one took."""
    from .labels import _base, _claims, competing_risk

    support = _claims(spark, d).join(_base(spark, d).where("label <> 3"), "entity").select(F.col("concept").alias("candidate"), "entity")
    sizes = support.groupBy("candidate").agg(F.count("*").alias("size"))
    return op.takeover(sizes.join(competing_risk(spark, d).select("candidate", "risk"), "candidate"), support, 0.9, 5)


@query("CMP10 GR16 GR17 MTH16 MTH17 MTH18 AGG14", None)
def guarded_refinement(spark, d):
    """Parts refined by groups of suppliers: classes by residue, positions from size, price and key."""
    from ..operators import refine
    from .labels import _props

    part = table(spark, d, "part")
    at = part.select(F.col("p_partkey").alias("entity"), (F.col("p_size") / 10).alias("x"), F.pmod("p_retailprice", F.lit(7.0)).alias("y"), (F.pmod("p_partkey", F.lit(53)) / 10).alias("z"))
    label = (1 + F.pmod("p_partkey", F.lit(6))).cast("int")
    base = part.select(F.col("p_partkey").alias("entity"), label.alias("label"), (1 + F.pmod(label, F.lit(3))).cast("int").alias("base_class"))
    props = _props(spark, d).withColumn("class_id", (1 + F.pmod("concept", F.lit(3))).cast("int"))
    sources = props.where("weight >= 30").select("grp", "class_id", "entity").distinct()
    claims = props.groupBy("class_id", "entity").agg(F.countDistinct("frame").alias("n")).where("n >= 6").select("class_id", "entity")
    groups = props.groupBy("grp").agg(F.countDistinct("region").alias("proposals"), F.countDistinct("frame").alias("views"))
    bounds = refine.Bounds(min_anchor=3, min_coverage=0.05, voxel=1.5)
    return refine.refined(sources, claims, base, at, groups, {1, 2}, bounds)[1].drop("parent")
