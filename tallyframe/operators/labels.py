"""Label algebra: claims, ownership, merges, transitions and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(base: DataFrame, extension: DataFrame, ids: DataFrame) -> DataFrame:
    """Base labels with extension labels laid over them.

    ``ids`` is (extension label, new label, place): the new label of the highest
    place wins, a later class covering an earlier one; the rest of the base stays.
    """
    over = (
        extension.join(ids, "extension")
        .groupBy("entity")
        .agg(F.max(F.struct("place", "new")).alias("o"))
        .select("entity", F.col("o.new").alias("new"))
    )
    return base.join(over, "entity", "left").select("entity", F.col("label").alias("base"), F.coalesce("new", "label").alias("label"))


def transitions(changes: DataFrame) -> DataFrame:
    """(base, label, n) where the label changed."""
    return changes.where("base <> label").groupBy("base", "label").agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame, source: str, predicted: str) -> DataFrame:
    """Counts of every pair of classes with the share of the source class's row."""
    counts = pairs.groupBy(source, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(source)))


def signed_gate(candidates: DataFrame, evidence: DataFrame, keys, min_positive: int, min_ratio: float) -> DataFrame:
    """Candidates with enough positive views, and enough of them among all; without evidence both are 0."""
    j = candidates.join(evidence, list(keys), "left")
    positive, negative = F.coalesce("positive", F.lit(0)), F.coalesce("negative", F.lit(0))
    ratio = positive / F.greatest(positive + negative, F.lit(1)).cast("double")
    return j.where((positive >= min_positive) & (ratio >= min_ratio)).drop("positive", "negative")


def exclusive(claims: DataFrame, item: str) -> DataFrame:
    """Claims on entities that one item alone claims."""
    one = claims.groupBy("entity").agg(F.countDistinct(item).alias("n"), F.min(item).alias(item)).where("n = 1")
    return one.select("entity", item)


def owners(supports: DataFrame) -> DataFrame:
    """Owner of each entity among (entity, cluster, class_id, n): most observers, the earlier cluster on a tie
    within a class, none on a tie across classes."""
    best = Window.partitionBy("entity")
    top = supports.withColumn("m", F.max("n").over(best)).where("n = m")
    return (
        top.groupBy("entity")
        .agg(F.min("cluster").alias("cluster"), F.countDistinct("class_id").alias("classes"), F.max("n").alias("n"))
        .select("entity", F.when(F.col("classes") == 1, F.col("cluster")).otherwise(F.lit(0)).alias("owner"), "n")
    )


def unconflicted(claims: DataFrame) -> DataFrame:
    """Per entity: 0 if clusters of several classes claim it, else the cluster of best score, smaller id on a tie."""
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("cluster")).alias("c")))
    return claims.groupBy("entity").agg(F.countDistinct("class_id").alias("classes"), best.alias("b")).select(
        "entity", F.when(F.col("classes") == 1, -F.col("b.c")).otherwise(F.lit(0)).alias("cluster")
    )


def plurality(counts: DataFrame, min_total: int) -> DataFrame:
    """The one class with most winners (no majority needed), 0 on a tie or with too few."""
    best = Window.partitionBy("entity")
    rows = counts.withColumn("m", F.max("n").over(best)).withColumn("total", F.sum("n").over(best))
    top = rows.where("n = m").groupBy("entity").agg(F.count("*").alias("ties"), F.min("class_id").alias("c"), F.max("total").alias("total"))
    return top.select("entity", F.when((F.col("ties") == 1) & (F.col("total") >= min_total), F.col("c")).otherwise(F.lit(0)).alias("label"), "total")


def competing(candidates: DataFrame, base: DataFrame, classes: DataFrame) -> DataFrame:
    """Per candidate set: the strongest class other than its own in the base below it, that class's
    strongest label there, how much of that label is covered, and the risk of cutting through it.

    ``candidates`` is (candidate, target, entity), ``base`` (entity, label) and
    ``classes`` (label, class_id).
    """
    sizes = base.groupBy("label").agg(F.count("*").alias("size"))
    total = candidates.groupBy("candidate").agg(F.count("*").alias("total"))
    counts = (
        candidates.join(base.where("label > 0"), "entity")
        .join(classes, "label")
        .where("class_id <> target")
        .groupBy("candidate", "class_id", "label")
        .agg(F.count("*").alias("overlap"))
    )
    by_class = counts.withColumn("class_overlap", F.sum("overlap").over(Window.partitionBy("candidate", "class_id")))
    order = Window.partitionBy("candidate").orderBy(F.desc("class_overlap"), "class_id", F.desc("overlap"), "label")
    best = by_class.withColumn("place", F.row_number().over(order)).where("place = 1").join(sizes, "label")
    fraction, coverage = F.col("class_overlap") / F.col("total"), F.col("overlap") / F.col("size")
    return total.join(best, "candidate", "left").select(
        "candidate",
        F.coalesce("class_id", F.lit(0)).alias("competing_class"),
        F.coalesce(fraction, F.lit(0.0)).alias("class_fraction"),
        F.coalesce("label", F.lit(0)).alias("competing_label"),
        F.coalesce(coverage, F.lit(0.0)).alias("coverage"),
        F.coalesce(fraction * (1 - coverage), F.lit(0.0)).alias("risk"),
    )


def frame_supports(proposals: DataFrame) -> DataFrame:
    """(grp, frame, score): a frame's best proposal score in a group."""
    return proposals.groupBy("grp", "frame").agg(F.max("score").alias("score"))


def assigned(proposals: DataFrame, priorities: Column, reliability_views: float, min_quality: float) -> DataFrame:
    """One group per entity by multi-view evidence.

    A group's evidence for an entity is the share of its frames' score that
    support it, times views / (views + reliability_views). The best evidence wins;
    priority times 1e-7 and then the smaller id decide ties.
    """
    frames = frame_supports(proposals).withColumn("score", F.greatest("score", F.lit(1e-6)))
    totals = frames.groupBy("grp").agg(F.sum("score").alias("total"), F.count("*").alias("views"))
    touched = proposals.select("grp", "frame", "entity").distinct().join(frames, ["grp", "frame"])
    quality = (
        touched.groupBy("grp", "entity")
        .agg(F.sum("score").alias("score"))
        .join(totals, "grp")
        .withColumn("evidence", F.col("score") / F.col("total") * F.col("views") / (F.col("views") + F.lit(reliability_views)))
        .where(F.round("evidence", 9) >= min_quality)
    )
    best = F.max(F.struct(F.round(F.col("evidence") + priorities * 1e-7, 9).alias("q"), (-F.col("grp")).alias("g")))
    return quality.groupBy("entity").agg(best.alias("b")).select("entity", (-F.col("b.g")).alias("grp"), F.col("b.q").alias("quality"))


def adaptive_minimum(views: Column, total_views: int, minimum: int, thing: Column, minimum_thing: int, minimum_stuff: int, stuff_ratio: float, floor: float) -> Column:
    """Smallest size to keep: the kind's minimum, relaxed by the share of views that saw the group, down to a floor share."""
    own = F.when(thing, F.lit(max(minimum, minimum_thing))).otherwise(F.lit(max(minimum, minimum_stuff)))
    share = views / F.lit(float(total_views))
    relaxed = F.ceil(own * F.greatest(F.lit(floor), 1 - share / 2))
    return F.when(thing | (share >= stuff_ratio), relaxed).otherwise(own).cast("bigint")


def renumbered(groups: DataFrame, order) -> DataFrame:
    """Ids from 1 in the given order; groups are a dimension."""
    return groups.withColumn("id", F.row_number().over(Window.orderBy(*order)))
