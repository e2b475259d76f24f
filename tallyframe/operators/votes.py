"""Projecting votes and picking winners.

A vote is (observer, entity, class_id, mass); class 0 abstains. Votes of one
observer on one entity are a handful of rows, one per class, so windows over
them are small; they are hash-partitioned by (observer, entity) once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OF_VIEW = ("observer", "entity")


def _by(*keys: str):
    return Window.partitionBy(*keys)


def normalised(votes: DataFrame, keys=OF_VIEW) -> DataFrame:
    """Mass as a fraction of all mass on the entity by the observer; without class 0 and zeros."""
    total = F.sum("mass").over(_by(*keys))
    return (
        votes.withColumn("weight", F.try_divide(F.col("mass"), total)).where("class_id > 0 and weight > 0").drop("mass")
    )


def unit_mass_errors(votes: DataFrame, keys=OF_VIEW, tolerance: float = 1e-5) -> DataFrame:
    """Groups whose weights don't sum to one, or that hold a class twice; must be empty."""
    return (
        votes.groupBy(*keys)
        .agg(F.sum("weight").alias("total"), F.count("*").alias("n"), F.countDistinct("class_id").alias("classes"))
        .where((F.abs(F.col("total") - 1) > tolerance) | (F.col("n") > F.col("classes")))
    )


def weighted_votes(votes: DataFrame, confidences: DataFrame, quality: Column, threshold: float = 0.0, keys=OF_VIEW) -> DataFrame:
    """Visible fraction times the class's mean confidence times the observer's quality; class 0 stays.

    ``threshold`` drops mass at or below it before the division.
    """
    total = F.sum("mass").over(_by(*keys))
    share = F.try_divide(F.col("mass"), total)
    return (
        votes.withColumn("share", share)
        .where(F.col("mass") > threshold)
        .join(confidences, "class_id", "left")
        .withColumn("weight", F.col("share") * F.coalesce("confidence", F.lit(1.0)) * quality)
        .drop("share", "confidence", "mass")
    )


def mean_confidence(pixels: DataFrame) -> DataFrame:
    """(class_id, confidence): mean of each class's values."""
    return pixels.groupBy("class_id").agg(F.avg("confidence").alias("confidence"))


def membership_votes(mass: DataFrame, observed: DataFrame) -> DataFrame:
    """A region's share of an entity's visible mass; shares of regions needn't sum to one."""
    return (
        mass.join(observed.withColumnRenamed("mass", "visible"), list(OF_VIEW))
        .withColumn("weight", F.try_divide(F.col("mass"), F.col("visible")))
        .where("weight > 0")
        .drop("mass", "visible")
    )


def mapped_class(raw: Column, override: Column, mapped: Column) -> Column:
    """The override where it is positive, else the mapped class, else 0."""
    return F.coalesce(F.when(override > 0, override), mapped, F.lit(0))


def compact_ids(classes: DataFrame, *columns: str) -> DataFrame:
    """Present non-zero keys numbered from 0 in order; a small dimension."""
    keys = classes.where(" and ".join(f"{c} <> 0" for c in columns[-1:])).select(*columns).distinct()
    return keys.withColumn("compact_id", (F.row_number().over(Window.orderBy(*columns)) - 1).cast("int"))


def with_unique_winner(votes: DataFrame, keys, value: str = "weight") -> DataFrame:
    """Per key: winner (0 on an exact tie) and its value."""
    best = F.max(value).over(_by(*keys))
    top = votes.withColumn("best", best).where(F.col(value) == F.col("best"))
    return top.groupBy(*keys).agg(
        F.when(F.count("*") == 1, F.max("class_id")).otherwise(F.lit(0)).alias("winner"),
        F.max("best").alias("value"),
        F.count("*").alias("ties"),
    )


def smallest_winner(votes: DataFrame, keys, value: str = "weight") -> DataFrame:
    """Per key: the class of the largest value, the smallest class on a tie; one pass, combined before the shuffle."""
    best = F.max(F.struct(F.col(value).alias("value"), (-F.col("class_id")).alias("c")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.c")).alias("winner"), F.col("b.value").alias("value"))


def dominant(votes: DataFrame, keys, item: str, min_weight: float) -> DataFrame:
    """Per key: the item with the one largest weight if that reaches ``min_weight``; none on a tie."""
    order = _by(*keys).orderBy(F.desc("weight"), item)
    return (
        votes.withColumn("place", F.row_number().over(order))
        .withColumn("next", F.lead("weight").over(order))
        .where(F.col("place") == 1)
        .where((F.col("weight") >= min_weight) & (F.col("next").isNull() | (F.col("weight") > F.col("next"))))
        .drop("place", "next")
    )


def winner_metrics(sums: DataFrame, tie_epsilon: float = 1e-6) -> DataFrame:
    """Per entity over all classes: raw winner (0 if the lead is within epsilon), winner and second values, agreement."""
    by = _by("entity")
    order = by.orderBy(F.desc("mass"), "class_id")
    return (
        sums.withColumn("place", F.row_number().over(order))
        .withColumn("second", F.coalesce(F.lead("mass").over(order), F.lit(0.0)))
        .withColumn("total", F.sum("mass").over(by))
        .where("place = 1")
        .select(
            "entity",
            F.when((F.col("mass") - F.col("second")) > tie_epsilon, F.col("class_id")).otherwise(F.lit(0)).alias("winner"),
            F.col("mass").alias("best"),
            "second",
            F.coalesce(F.try_divide(F.col("mass"), F.col("total")), F.lit(0.0)).alias("agreement"),
        )
    )


def semantic_metrics(sums: DataFrame, tie_epsilon: float = 1e-6) -> DataFrame:
    """winner_metrics over classes above 0, with the share of evidence that isn't abstention."""
    return winner_metrics(sums.where("class_id > 0"), tie_epsilon).join(evidence_fraction(sums), "entity")


def evidence_fraction(sums: DataFrame) -> DataFrame:
    semantic = F.sum(F.when(F.col("class_id") > 0, F.col("mass")).otherwise(0.0))
    return sums.groupBy("entity").agg(F.coalesce(F.try_divide(semantic, F.sum("mass")), F.lit(0.0)).alias("evidence"))


def accepted_winner(winner: Column, support: Column, agreement: Column, min_views: int, min_agreement: float, evidence: Column | None = None, min_evidence: float = 0.0) -> Column:
    """The winner where every bound is reached, else 0."""
    good = (winner > 0) & (support >= min_views) & (agreement >= min_agreement)
    return F.when(good if evidence is None else good & (evidence >= min_evidence), winner).otherwise(F.lit(0))


def supporting_observers(votes: DataFrame, winners: DataFrame) -> DataFrame:
    """Distinct observers with a vote on the entity's winner."""
    return (
        votes.join(winners.where("winner > 0").select("entity", F.col("winner").alias("class_id")), ["entity", "class_id"])
        .groupBy("entity")
        .agg(F.countDistinct("observer").alias("support"))
    )


def accumulated(votes: DataFrame, value: str = "mass") -> DataFrame:
    return votes.groupBy("entity", "class_id").agg(F.sum(value).alias("mass"), F.countDistinct("observer").alias("support"))


def reliability_weight(observed: DataFrame, absolute: float, relative: float) -> DataFrame:
    """min(1, mass / max(absolute, relative * the entity's peak mass))."""
    peak = F.max("mass").over(_by("entity"))
    return observed.withColumn("reliability", F.least(F.lit(1.0), F.col("mass") / F.greatest(F.lit(absolute), F.lit(relative) * peak)))


def informative(observed: DataFrame, absolute: float, relative: float) -> DataFrame:
    """Observations of at least max(absolute, relative * peak) mass."""
    peak = F.max("mass").over(_by("entity"))
    return (
        observed.withColumn("peak", peak)
        .where((F.col("mass") > 0) & (F.col("mass") >= F.greatest(F.lit(absolute), F.lit(relative) * F.col("peak"))))
        .drop("peak")
    )
