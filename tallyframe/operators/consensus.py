"""Consensus of observers, calibrated reliabilities and recovery of abstentions.

Winners are (observer, entity, winner, value) with winner 0 where an observer
abstains. Counts by (entity, class) are combined before the shuffle; statistics
then need one row per class of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of an entity's consensus.
ACCEPTED, UNOBSERVED, SINGLE, TIE, NO_MAJORITY = 0, 1, 2, 3, 4
# Codes of a membership.
MEMBER, MEMBER_SINGLE, MEMBER_WEAK = 1, 2, 3
# Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def winner_counts(winners: DataFrame) -> DataFrame:
    """(entity, class_id, n): observers whose winner is the class, each counting the same."""
    return winners.where("winner > 0").groupBy("entity", F.col("winner").alias("class_id")).agg(F.count("*").alias("n"))


def status_of(total: Column, maximum: Column, ties: Column) -> Column:
    return (
        F.when(total == 0, F.lit(UNOBSERVED))
        .when(total == 1, F.lit(SINGLE))
        .when(ties > 1, F.lit(TIE))
        .when(maximum * 2 > total, F.lit(ACCEPTED))
        .otherwise(F.lit(NO_MAJORITY))
    )


def statistics(counts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Per entity: total, winner, maximum, second, ties, the first two tied classes, status, share.

    ``entities`` adds those without any count as unobserved.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "class_id")))
    rows = counts.groupBy("entity").agg(F.sum("n").alias("total"), ranked.alias("r"))
    if entities is not None:
        rows = entities.select("entity").distinct().join(rows, "entity", "left")
    n = lambda k: F.coalesce(-F.get("r", F.lit(k)).down, F.lit(0))
    c = lambda k: F.coalesce(F.get("r", F.lit(k)).class_id, F.lit(0))
    tied = F.coalesce(F.size(F.filter("r", lambda x: x.down == F.get("r", F.lit(0)).down)), F.lit(0))
    total = F.coalesce("total", F.lit(0))
    return rows.select(
        "entity",
        total.alias("total"),
        c(0).alias("winner"),
        n(0).alias("maximum"),
        n(1).alias("second"),
        tied.alias("ties"),
        c(0).alias("tie_first"),
        F.when(tied > 1, c(1)).otherwise(F.lit(0)).alias("tie_second"),
        status_of(total, n(0), tied).alias("status"),
        F.coalesce(F.try_divide(n(0).cast("double"), total.cast("double")), F.lit(0.0)).alias("share"),
    )


def labels(stats: DataFrame) -> DataFrame:
    return stats.select("entity", F.when(F.col("status") == ACCEPTED, F.col("winner")).otherwise(F.lit(0)).alias("label"), "status")


def leave_one_out(winners: DataFrame, stats: DataFrame) -> DataFrame:
    """Per observer and entity: the strict majority of all others, from the statistics alone.

    Taking one vote away changes one count by one: the winner's (which may then
    tie with the second) or that of one of two tied classes.
    """
    h, total = F.col("held"), F.col("total") - (F.col("held") > 0).cast("int")
    own = (F.col("ties") == 1) & (h == F.col("winner")) & (h > 0)
    left = F.when(own, F.col("maximum") - 1).otherwise(F.col("maximum"))
    candidate = (
        F.when(F.col("ties") == 1, F.when(own & (left == F.col("second")), F.lit(0)).otherwise(F.col("winner")))
        .when((F.col("ties") == 2) & (h > 0) & (h == F.col("tie_first")), F.col("tie_second"))
        .when((F.col("ties") == 2) & (h > 0) & (h == F.col("tie_second")), F.col("tie_first"))
        .otherwise(F.lit(0))
    )
    joined = winners.select("observer", "entity", F.col("winner").alias("held")).join(stats, "entity")
    good = (total >= 2) & (candidate > 0) & (left * 2 > total)
    return joined.select("observer", "entity", "held", F.when(good, candidate).otherwise(F.lit(0)).alias("others"), total.alias("remaining"))


def wilson_lower(successes: Column, trials: Column, z: float = Z95) -> Column:
    """Lower bound of the Wilson score interval; 0 without trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(trials > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))).otherwise(F.lit(0.0))


def reliabilities(loo: DataFrame, z: float = Z95) -> DataFrame:
    """Per observer: trials and agreements with the others' consensus, and the Wilson bound."""
    tried = (F.col("others") > 0) & (F.col("held") > 0)
    return (
        loo.groupBy("observer")
        .agg(F.count_if(tried).alias("trials"), F.count_if(tried & (F.col("others") == F.col("held"))).alias("agreed"))
        .withColumn("reliability", wilson_lower(F.col("agreed"), F.col("trials"), z))
    )


def against_locked(winners: DataFrame, locked: DataFrame, z: float = Z95) -> DataFrame:
    """Reliabilities of additional observers against fixed labels."""
    joined = winners.select("observer", "entity", F.col("winner").alias("held")).join(
        locked.select("entity", F.col("label").alias("others")), "entity", "left"
    )
    return reliabilities(joined.withColumn("others", F.coalesce("others", F.lit(0))), z)


def weighted_scores(winners: DataFrame, reliability: DataFrame) -> DataFrame:
    """(entity, class_id, score, observers): reliability times the winner's value, summed."""
    return (
        winners.where("winner > 0")
        .join(reliability.select("observer", "reliability"), "observer")
        .groupBy("entity", F.col("winner").alias("class_id"))
        .agg(F.sum(F.col("reliability") * F.col("value")).alias("score"), F.count("*").alias("observers"))
    )


def weighted_majority(scores: DataFrame, digits: int = 9) -> DataFrame:
    """Per entity: the one class with more than half of the score, else 0; and its observers.

    Scores are rounded to ``digits`` places first, so that sums in another order tie alike.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("score", digits)).alias("down"), "class_id")))
    rows = scores.groupBy("entity").agg(ranked.alias("r"), F.sum("score").alias("total"), F.sum("observers").alias("observers"))
    best, second = -F.get("r", F.lit(0)).down, F.coalesce(-F.get("r", F.lit(1)).down, F.lit(0.0))
    good = (best > second) & (best * 2 > F.round("total", digits)) & (best > 0)
    return rows.select("entity", F.when(good, F.get("r", F.lit(0)).class_id).otherwise(F.lit(0)).alias("prediction"), "observers")


def recovered(stats: DataFrame, scores: DataFrame, min_observers: int = 2) -> DataFrame:
    """(entity, status, label, source): 1 consensus, 2 recovered from a single, tied or split vote, 0 none."""
    majority = weighted_majority(scores)
    wanted = F.col("status").isin(SINGLE, TIE, NO_MAJORITY) & (F.col("prediction") > 0) & (F.col("observers") >= min_observers)
    return stats.join(majority, "entity", "left").select(
        "entity",
        "status",
        F.when(F.col("status") == ACCEPTED, F.col("winner")).when(wanted, F.col("prediction")).otherwise(F.lit(0)).alias("label"),
        F.when(F.col("status") == ACCEPTED, F.lit(1)).when(wanted, F.lit(2)).otherwise(F.lit(0)).alias("source"),
    )


def recovery_violations(hard: DataFrame, candidate: DataFrame) -> DataFrame:
    """Counts of broken invariants, all zero if the recovery only fills what abstained."""
    j = hard.select("entity", F.col("label").alias("hard")).join(candidate, "entity", "full")
    accepted = F.col("status") == ACCEPTED
    return j.agg(
        F.count_if(F.col("hard").isNull() | F.col("label").isNull()).alias("missing"),
        F.count_if(accepted & (F.col("hard") != F.col("label"))).alias("anchors_changed"),
        F.count_if(accepted != (F.col("source") == 1)).alias("anchor_codes"),
        F.count_if((F.col("status") == UNOBSERVED) & (F.col("label") > 0)).alias("unobserved_filled"),
        F.count_if((F.col("source") >= 2) & accepted).alias("recovered_anchors"),
        F.count_if((F.col("source") == 0) != (F.col("label") == 0)).alias("zero_codes"),
        F.count_if(F.col("source") >= 2).alias("recovered"),
    )


def membership(events: DataFrame, observed: DataFrame, threshold: float = 0.5, weighted: bool = False) -> DataFrame:
    """(entity, cluster, support, observed, score, status) of clusters voted by observers.

    A single supporting observer is its own status whatever the score.
    """
    agg = [F.count("*").alias("support")] + ([F.sum("weight").alias("support_weight")] if weighted else [])
    rows = events.groupBy("entity", "cluster").agg(*agg).join(observed, "entity", "left")
    score = F.try_divide(F.col("support_weight"), F.col("observed_weight")) if weighted else F.try_divide(F.col("support").cast("double"), F.col("observed").cast("double"))
    return rows.withColumn("score", score).withColumn(
        "status",
        F.when(F.col("support") == 1, F.lit(MEMBER_SINGLE)).when(F.col("score") > threshold, F.lit(MEMBER)).otherwise(F.lit(MEMBER_WEAK)),
    )


def membership_violations(members: DataFrame) -> DataFrame:
    """Votes on entities never observed, and more votes than observers."""
    return members.agg(
        F.count_if(F.col("observed").isNull() | (F.col("observed") == 0)).alias("unobserved"),
        F.count_if(F.col("support") > F.col("observed")).alias("oversupported"),
    )


def pooled(members: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """Memberships of clusters added up by concept; an entity's observers count once."""
    rows = (
        members.join(concepts, "cluster")
        .groupBy("entity", "concept")
        .agg(F.sum("support").alias("support"), F.first("observed").alias("observed"))
    )
    score = F.try_divide(F.col("support").cast("double"), F.col("observed").cast("double"))
    return rows.withColumn("score", score).withColumn(
        "status",
        F.when(F.col("support") == 1, F.lit(MEMBER_SINGLE)).when(F.col("score") > threshold, F.lit(MEMBER)).otherwise(F.lit(MEMBER_WEAK)),
    )


def flat_labels(members: DataFrame, item: str, priorities: DataFrame) -> DataFrame:
    """One accepted item per entity: by priority, score, smaller size, smaller id.

    ``priorities`` is (item, priority, size); a struct's maximum is combined before the shuffle.
    """
    key = F.struct("priority", F.round("score", 9).alias("score"), (-F.col("size")).alias("s"), (-F.col(item)).alias("i"))
    return (
        members.where(F.col("status") == MEMBER)
        .join(priorities, item)
        .groupBy("entity")
        .agg(F.max(key).alias("k"))
        .select("entity", (-F.col("k.i")).alias(item))
    )


def replacements(base: DataFrame, evidence: DataFrame, targets: list[int], visible_min: int = 3, wins_min: int = 2, share_min: float = 0.5, mass_min: float = 0.35, positive_min: int = 2, margin: float = 0.05) -> DataFrame:
    """Gated replacement of base labels by new classes.

    ``evidence`` is (entity, class_id, wins, positive, mass) for every class,
    ``base`` (entity, label, visible, incumbent_wins). The candidate is the target
    with most wins, then most mass, then the smaller id; it replaces the base if it
    passes every bound and the base isn't a target already.
    """
    key = F.struct("wins", F.round("mass", 9).alias("mass"), (-F.col("class_id")).alias("c"), "positive")
    best = evidence.where(F.col("class_id").isin(targets)).groupBy("entity").agg(F.max(key).alias("k"))
    j = base.join(best, "entity", "left")
    visible = F.greatest(F.coalesce("visible", F.lit(0)), F.lit(1)).cast("double")
    wins, mass = F.coalesce("k.wins", F.lit(0)), F.coalesce("k.mass", F.lit(0.0))
    fill = (
        (F.coalesce("visible", F.lit(0)) >= visible_min)
        & (wins >= wins_min)
        & (wins / visible >= share_min)
        & (wins / visible >= F.coalesce("incumbent_wins", F.lit(0)) / visible + margin)
        & (mass / visible >= mass_min)
        & (F.coalesce("k.positive", F.lit(0)) >= positive_min)
        & ~F.col("label").isin(targets)
    )
    fill = F.coalesce(fill, F.lit(False))
    return j.select("entity", F.col("label").alias("base"), F.when(fill, -F.col("k.c")).otherwise(F.col("label")).alias("label"), fill.alias("filled"))
