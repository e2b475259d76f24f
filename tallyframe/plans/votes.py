"""Votes: projection, accumulation and winners."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import votes as op
from ..sources.encodings import R1, V1, V2, event_votes, order_votes, regions
from .registry import query

NORM = """norm AS (SELECT observer, entity, class_id, mass / sum(mass) OVER (PARTITION BY observer, entity) AS weight FROM votes)"""
SUMS = """sums AS (SELECT entity, class_id, sum(mass) AS mass, count(DISTINCT observer) AS support FROM votes GROUP BY ALL)"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("PRJ1 AGG40 SRC8", f"WITH {V1}, {NORM} SELECT observer, entity, class_id, round(weight, 6) AS weight FROM norm WHERE weight > 0")
def vote_normalise(spark, d):
    return _rounded(op.normalised(event_votes(spark, d)), "weight")


@query("PRJ1 CHK11", f"WITH {V2}, {NORM} SELECT count(*) AS bad FROM (SELECT 1 FROM norm GROUP BY observer, entity HAVING abs(sum(weight) - 1) > 1e-5 OR count(*) > count(DISTINCT class_id))")
def unit_mass_violations(spark, d):
    return op.unit_mass_errors(op.normalised(order_votes(spark, d))).agg(F.count("*").alias("bad"))


@query(
    "PRJ2 AGG6 X8",
    f"""WITH {V2}, shifted AS (SELECT observer, entity, class_id - 1 AS class_id, mass FROM votes),
conf AS (SELECT class_id, avg(CAST(observer % 10 AS DOUBLE) / 10) AS confidence FROM shifted GROUP BY 1),
w AS (SELECT *, mass / sum(mass) OVER (PARTITION BY observer, entity) AS share FROM shifted)
SELECT observer, entity, class_id, round(share * confidence * (0.5 + CAST(observer % 2 AS DOUBLE) / 2), 6) AS weight FROM w JOIN conf USING (class_id) WHERE mass > 5""",
)
def vote_confidence_weighted(spark, d):
    votes = order_votes(spark, d).withColumn("class_id", F.col("class_id") - 1)
    conf = op.mean_confidence(votes.select("class_id", (F.pmod("observer", F.lit(10)).cast("double") / 10).alias("confidence")))
    quality = F.lit(0.5) + F.pmod("observer", F.lit(2)).cast("double") / 2
    return _rounded(op.weighted_votes(votes, conf, quality, 5.0), "weight").select("observer", "entity", "class_id", "weight")


@query(
    "PRJ3 SRC10",
    f"""WITH {V2}, seen AS (SELECT observer, entity, sum(mass) AS visible FROM votes GROUP BY ALL)
SELECT observer, entity, class_id, round(mass / visible, 6) AS weight FROM votes JOIN seen USING (observer, entity)""",
)
def region_membership_votes(spark, d):
    votes = order_votes(spark, d)
    seen = votes.groupBy("observer", "entity").agg(F.sum("mass").alias("mass"))
    return _rounded(op.membership_votes(votes, seen), "weight").select("observer", "entity", "class_id", "weight")


@query(
    "PRJ4 PRJ7 PRJ8 PRJ9",
    f"""WITH {V1} SELECT observer, entity, class_id, CASE WHEN observer % 7 = 0 THEN 9 WHEN class_id <= 3 THEN class_id * 10 ELSE 0 END AS mapped FROM votes""",
)
def class_remap(spark, d):
    votes = event_votes(spark, d)
    table = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "class_id int, mapped int")
    override = F.when(F.pmod("observer", F.lit(7)) == 0, F.lit(9)).otherwise(F.lit(0))
    joined = votes.join(F.broadcast(table), "class_id", "left")
    return joined.select("observer", "entity", "class_id", op.mapped_class(F.col("class_id"), override, F.col("mapped")).alias("mapped"))


@query(
    "PRJ5 X9",
    f"""WITH {V2}, k AS (SELECT DISTINCT CAST(observer % 4 AS INT) AS level, class_id FROM votes WHERE class_id % 2 = 1)
SELECT level, class_id, CAST(row_number() OVER (ORDER BY level, class_id) - 1 AS INT) AS compact_id FROM k""",
)
def compact_pairs(spark, d):
    keys = order_votes(spark, d).select(F.pmod("observer", F.lit(4)).cast("int").alias("level"), "class_id").where("class_id % 2 = 1")
    return op.compact_ids(keys, "level", "class_id")


@query(
    "PRJ6 CHK9",
    f"""WITH {V1} SELECT count(*) FILTER (class_id > 5) AS sentinel_rows, count(*) FILTER (mass <= 0) AS empty_rows, count(*) AS total_rows FROM votes""",
)
def sentinel_rows(spark, d):
    return event_votes(spark, d).agg(
        F.count_if(F.col("class_id") > 5).alias("sentinel_rows"), F.count_if(F.col("mass") <= 0).alias("empty_rows"), F.count("*").alias("total_rows")
    )


@query("AGG1 AGG2 SRC9", f"WITH {V2}, {SUMS} SELECT * FROM sums")
def vote_accumulate(spark, d):
    return op.accumulated(order_votes(spark, d))


WINNER = """top AS (SELECT observer, entity, class_id, weight, max(weight) OVER (PARTITION BY observer, entity) AS best FROM norm),
win AS (SELECT observer, entity, CASE WHEN count(*) = 1 THEN max(class_id) ELSE 0 END AS winner, max(best) AS value, count(*) AS ties FROM top WHERE weight = best GROUP BY 1, 2)"""


@query("WIN1 WIN2", f"WITH {V1}, {NORM}, {WINNER} SELECT observer, entity, winner, round(value, 6) AS value, ties FROM win")
def observer_winner_abstain(spark, d):
    return _rounded(op.with_unique_winner(op.normalised(event_votes(spark, d)), op.OF_VIEW), "value")


@query(
    "WIN3 WIN12 WIN13 WIN14",
    f"""WITH {V1} SELECT observer, entity, class_id AS winner, mass AS value FROM votes
QUALIFY row_number() OVER (PARTITION BY observer, entity ORDER BY mass DESC, class_id) = 1""",
)
def observer_winner_min_class(spark, d):
    return op.smallest_winner(event_votes(spark, d), op.OF_VIEW, "mass")


@query(
    "WIN4",
    f"""WITH {R1}, w AS (SELECT concept, view, entity, region, weight / sum(weight) OVER (PARTITION BY concept, view, entity) AS weight FROM regions),
r AS (SELECT *, row_number() OVER o AS place, lead(weight) OVER o AS nxt FROM w WINDOW o AS (PARTITION BY concept, view, entity ORDER BY weight DESC, region))
SELECT concept, view, entity, region, round(weight, 6) AS weight FROM r WHERE place = 1 AND weight >= 0.5 AND (nxt IS NULL OR weight > nxt)""",
)
def dominant_region(spark, d):
    rows = regions(spark, d)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("concept", "view", "entity"))
    votes = rows.select("concept", "view", "entity", "region", share.alias("weight"))
    return _rounded(op.dominant(votes, ["concept", "view", "entity"], "region", 0.5), "weight")


METRICS = """ranked AS (SELECT entity, class_id, mass, row_number() OVER o AS place, coalesce(lead(mass) OVER o, 0.0) AS second, sum(mass) OVER (PARTITION BY entity) AS total
  FROM {t} WINDOW o AS (PARTITION BY entity ORDER BY mass DESC, class_id)),
met AS (SELECT entity, CASE WHEN mass - second > 1e-6 THEN class_id ELSE 0 END AS winner, mass AS best, second, mass / total AS agreement FROM ranked WHERE place = 1)"""
ABSTAIN = "zero AS (SELECT entity, class_id - 1 AS class_id, mass FROM sums)"


def _sums(spark, d):
    return op.accumulated(event_votes(spark, d)).withColumn("class_id", F.col("class_id") - 1)


@query("WIN5 WIN16", f"WITH {V1}, {SUMS}, {ABSTAIN}, {METRICS.format(t='zero')} SELECT entity, winner, best, second, round(agreement, 6) AS agreement FROM met")
def winner_margin_joint(spark, d):
    return _rounded(op.winner_metrics(_sums(spark, d)), "agreement")


@query(
    "WIN6 AGG4",
    f"""WITH {V1}, {SUMS}, {ABSTAIN}, semantic AS (SELECT * FROM zero WHERE class_id > 0), {METRICS.format(t='semantic')},
ev AS (SELECT entity, coalesce(sum(mass) FILTER (class_id > 0), 0) / sum(mass) AS evidence FROM zero GROUP BY 1)
SELECT entity, winner, best, second, round(agreement, 6) AS agreement, round(evidence, 6) AS evidence FROM met JOIN ev USING (entity)""",
)
def winner_margin_semantic(spark, d):
    return _rounded(op.semantic_metrics(_sums(spark, d)), "agreement", "evidence")


@query("AGG4", f"WITH {V1}, {SUMS}, {ABSTAIN} SELECT entity, round(coalesce(sum(mass) FILTER (class_id > 0), 0) / sum(mass), 6) AS evidence FROM zero GROUP BY 1")
def evidence_fraction(spark, d):
    return _rounded(op.evidence_fraction(_sums(spark, d)), "evidence")


GATED = f"""{SUMS}, {METRICS.format(t='sums')},
sup AS (SELECT m.entity, count(DISTINCT v.observer) AS support FROM met m JOIN votes v ON v.entity = m.entity AND v.class_id = m.winner WHERE winner > 0 GROUP BY 1)"""


@query("AGG5 AGG12", f"WITH {V2}, {GATED} SELECT entity, support FROM sup")
def supporting_observers(spark, d):
    votes = order_votes(spark, d)
    return op.supporting_observers(votes, op.winner_metrics(op.accumulated(votes)))


@query(
    "FLT1 WIN7 WIN16",
    f"""WITH {V2}, {GATED} SELECT m.entity, CASE WHEN winner > 0 AND coalesce(support, 0) >= 3 AND agreement >= 0.5 THEN winner ELSE 0 END AS label FROM met m LEFT JOIN sup USING (entity)""",
)
def threshold_winners(spark, d):
    votes = order_votes(spark, d)
    metrics = op.winner_metrics(op.accumulated(votes))
    joined = metrics.join(op.supporting_observers(votes, metrics), "entity", "left")
    label = op.accepted_winner(F.col("winner"), F.coalesce("support", F.lit(0)), F.col("agreement"), 3, 0.5)
    return joined.select("entity", label.alias("label"))


@query(
    "WIN7 MTH8",
    f"""WITH {V2}, {SUMS}, seen AS (SELECT entity, count(DISTINCT observer) AS visible FROM votes GROUP BY 1),
best AS (SELECT entity, class_id, mass, support, mass / sum(mass) OVER (PARTITION BY entity) AS share FROM sums QUALIFY row_number() OVER (PARTITION BY entity ORDER BY mass DESC, class_id) = 1)
SELECT entity, CASE WHEN support >= 2 AND share >= 0.4 AND support >= 0.25 * visible THEN class_id ELSE 0 END AS label FROM best JOIN seen USING (entity)""",
)
def column_winner(spark, d):
    votes = order_votes(spark, d)
    sums = op.accumulated(votes)
    seen = votes.groupBy("entity").agg(F.countDistinct("observer").alias("visible"))
    best = (
        sums.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("entity")))
        .withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("mass"), "class_id")))
        .where("place = 1")
    )
    good = (F.col("support") >= 2) & (F.col("share") >= 0.4) & (F.col("support") >= 0.25 * F.col("visible"))
    return best.join(seen, "entity").select("entity", F.when(good, F.col("class_id")).otherwise(0).alias("label"))


@query(
    "WIN20",
    f"""WITH {V2}, {NORM}, r AS (SELECT observer, entity, class_id, weight, row_number() OVER o AS place, coalesce(lead(weight) OVER o, 0) AS second FROM norm WINDOW o AS (PARTITION BY observer, entity ORDER BY weight DESC, class_id))
SELECT observer, entity, class_id AS winner, round(weight, 6) AS share, round(weight - second, 6) AS margin, class_id = 1 + entity % 4 AS confirms FROM r WHERE place = 1""",
)
def observer_share_margin(spark, d):
    order = Window.partitionBy(*op.OF_VIEW).orderBy(F.desc("weight"), "class_id")
    rows = (
        op.normalised(order_votes(spark, d))
        .withColumn("place", F.row_number().over(order))
        .withColumn("second", F.coalesce(F.lead("weight").over(order), F.lit(0.0)))
        .where("place = 1")
    )
    return rows.select(
        "observer",
        "entity",
        F.col("class_id").alias("winner"),
        F.round("weight", 6).alias("share"),
        F.round(F.col("weight") - F.col("second"), 6).alias("margin"),
        (F.col("class_id") == 1 + F.pmod("entity", F.lit(4))).alias("confirms"),
    )


OBS = "seen AS (SELECT observer, entity, sum(mass) AS mass FROM votes GROUP BY ALL)"


def _observed(spark, d):
    return order_votes(spark, d).groupBy("observer", "entity").agg(F.sum("mass").alias("mass"))


@query("FLT2 X37", f"WITH {V2}, {OBS}, p AS (SELECT *, max(mass) OVER (PARTITION BY entity) AS peak FROM seen) SELECT observer, entity, mass FROM p WHERE mass > 0 AND mass >= greatest(5.0, 0.6 * peak)")
def visibility_gate(spark, d):
    return op.informative(_observed(spark, d), 5.0, 0.6)


@query("WIN24", f"WITH {V2}, {OBS}, p AS (SELECT *, max(mass) OVER (PARTITION BY entity) AS peak FROM seen) SELECT observer, entity, mass, round(least(1.0, mass / greatest(10.0, 0.5 * peak)), 6) AS reliability FROM p")
def visibility_weight(spark, d):
    return _rounded(op.reliability_weight(_observed(spark, d), 10.0, 0.5), "reliability")


@query(
    "FLT6 X10 AGG39",
    f"""WITH {V2}, {NORM}, top AS (SELECT observer, entity, max(weight) AS p FROM norm GROUP BY ALL)
SELECT observer, count(*) FILTER (p >= 0.25) AS level0, count(*) FILTER (p >= 0.5) AS level1, count(*) FILTER (p >= 0.75) AS level2, count(*) FILTER (p >= 0.999) AS level3,
  CAST(sum(CAST(p >= 0.5 AS INT) + CAST(p >= 0.75 AS INT) + CAST(p >= 0.999 AS INT)) AS BIGINT) AS levels FROM top GROUP BY 1""",
)
def nested_confidence_levels(spark, d):
    top = op.normalised(order_votes(spark, d)).groupBy(*op.OF_VIEW).agg(F.max("weight").alias("p"))
    bounds = (0.25, 0.5, 0.75, 0.999)
    reached = sum((F.col("p") >= t).cast("int") for t in bounds[1:])
    return top.groupBy("observer").agg(
        *(F.count_if(F.col("p") >= t).alias(f"level{k}") for k, t in enumerate(bounds)), F.sum(reached).alias("levels")
    )
