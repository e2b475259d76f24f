"""Consensus labels, reliabilities, recovery, memberships and gated replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as op
from ..operators import votes as vt
from ..sources.encodings import R1, V1, V2, event_votes, order_votes, regions
from .registry import query
from .votes import NORM, WINNER

COUNTS = "counts AS (SELECT entity, winner AS class_id, count(*) AS n FROM win WHERE winner > 0 GROUP BY ALL)"
STATS = """st AS (SELECT e.entity, coalesce(sum(n), 0) AS total, coalesce(max(n), 0) AS maximum, coalesce(arg_max(class_id, n * 1000 - class_id), 0) AS winner,
    coalesce((SELECT count(*) FROM counts c2 WHERE c2.entity = e.entity AND c2.n = (SELECT max(n) FROM counts c3 WHERE c3.entity = e.entity)), 0) AS ties
  FROM (SELECT DISTINCT entity FROM votes) e LEFT JOIN counts c ON c.entity = e.entity GROUP BY e.entity),
stat AS (SELECT entity, CAST(total AS BIGINT) AS total, maximum, winner, ties, CASE WHEN total = 0 THEN 1 WHEN total = 1 THEN 2 WHEN ties > 1 THEN 3 WHEN maximum * 2 > total THEN 0 ELSE 4 END AS status FROM st)"""


def chain(votes):
    return f"{votes}, {NORM}, {WINNER}, {COUNTS}, {STATS}"


def _winners(votes):
    return vt.with_unique_winner(vt.normalised(votes), vt.OF_VIEW).select("observer", "entity", "winner", F.round("value", 9).alias("value"))


def _stats(votes, winners):
    return op.statistics(op.winner_counts(winners), votes)


@query("AGG3 AGG2", f"WITH {chain(V1)} SELECT entity, total, winner, maximum, CAST(ties AS INT) AS ties, status FROM stat")
def consensus_status(spark, d):
    votes = event_votes(spark, d)
    return _stats(votes, _winners(votes)).select("entity", "total", "winner", "maximum", "ties", "status")


@query("CMP1 AGG3 WIN1", f"WITH {chain(V2)} SELECT entity, CASE WHEN status = 0 THEN winner ELSE 0 END AS label, status FROM stat")
def consensus_labels(spark, d):
    votes = order_votes(spark, d)
    return op.labels(_stats(votes, _winners(votes)))


@query("AGG28 AGG15 AGG27", f"WITH {chain(V2)} SELECT code AS status, count(entity) AS n FROM (VALUES (0), (1), (2), (3), (4)) c(code) LEFT JOIN stat ON status = code GROUP BY 1")
def status_histogram(spark, d):
    votes = order_votes(spark, d)
    codes = spark.createDataFrame([(k,) for k in range(5)], "status int")
    found = _stats(votes, _winners(votes)).groupBy("status").agg(F.count("*").alias("n"))
    return codes.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


BRUTE = """pairs AS (SELECT w.observer, w.entity, w.winner AS held, o.winner AS other FROM win w LEFT JOIN win o ON o.entity = w.entity AND o.observer <> w.observer AND o.winner > 0),
per AS (SELECT observer, entity, held, other, count(other) AS n FROM pairs GROUP BY ALL),
tot AS (SELECT observer, entity, held, CAST(coalesce(sum(n), 0) AS BIGINT) AS remaining, max(n) AS m FROM per GROUP BY ALL),
loo AS (SELECT t.observer, t.entity, t.held, t.remaining, CASE WHEN t.remaining >= 2 AND 2 * t.m > t.remaining THEN (SELECT max(p.other) FROM per p WHERE p.observer = t.observer AND p.entity = t.entity AND p.n = t.m) ELSE 0 END AS others FROM tot t)"""


@query("WIN25", f"WITH {V1}, {NORM}, {WINNER}, {BRUTE} SELECT observer, entity, held, others, remaining FROM loo")
def leave_one_out(spark, d):
    votes = event_votes(spark, d)
    winners = _winners(votes)
    return op.leave_one_out(winners, _stats(votes, winners)).withColumn("remaining", F.col("remaining").cast("bigint"))


WILSON = """CASE WHEN trials > 0 THEN greatest(0, (agreed / trials + 3.841458820694124 / (2 * trials) - 1.959963984540054 * sqrt((agreed / trials * (1 - agreed / trials) + 3.841458820694124 / (4 * trials)) / trials)) / (1 + 3.841458820694124 / trials)) ELSE 0 END"""
RELIABILITY = f"""tried AS (SELECT observer, count(*) FILTER (held > 0 AND others > 0) AS trials, count(*) FILTER (held > 0 AND others > 0 AND held = others) AS agreed FROM loo GROUP BY 1),
rel AS (SELECT observer, trials, agreed, CAST({WILSON} AS DOUBLE) AS reliability FROM tried)"""


@query("CMP2 MTH1", f"WITH {V1}, {NORM}, {WINNER}, {BRUTE}, {RELIABILITY} SELECT observer, trials, agreed, round(reliability, 6) AS reliability FROM rel")
def observer_reliability(spark, d):
    votes = event_votes(spark, d)
    winners = _winners(votes)
    return op.reliabilities(op.leave_one_out(winners, _stats(votes, winners))).withColumn("reliability", F.round("reliability", 6))


@query(
    "CMP3",
    f"""WITH {chain(V2)}, lab AS (SELECT entity, CASE WHEN status = 0 THEN winner ELSE 0 END AS label FROM stat),
loo AS (SELECT w.observer, w.winner AS held, coalesce(l.label, 0) AS others FROM win w LEFT JOIN lab l USING (entity)), {RELIABILITY}
SELECT observer, trials, agreed, round(reliability, 6) AS reliability FROM rel""",
)
def additional_observer_reliability(spark, d):
    votes = order_votes(spark, d)
    winners = _winners(votes)
    locked = op.labels(_stats(votes, winners))
    return op.against_locked(winners, locked).withColumn("reliability", F.round("reliability", 6))


SCORES = """sc AS (SELECT entity, winner AS class_id, sum(reliability * round(value, 9)) AS score, count(*) AS observers FROM win JOIN rel USING (observer) WHERE winner > 0 GROUP BY ALL)"""
RECOVER = """rk AS (SELECT entity, class_id, round(score, 9) AS s, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, class_id) AS place, coalesce(lead(round(score, 9)) OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, class_id), 0) AS second, round(sum(score) OVER (PARTITION BY entity), 9) AS total, sum(observers) OVER (PARTITION BY entity) AS observers FROM sc),
maj AS (SELECT entity, CASE WHEN s > second AND 2 * s > total AND s > 0 THEN class_id ELSE 0 END AS prediction, observers FROM rk WHERE place = 1),
rec AS (SELECT s.entity, s.status, CASE WHEN status = 0 THEN winner WHEN status IN (2, 3, 4) AND prediction > 0 AND observers >= 2 THEN prediction ELSE 0 END AS label,
  CASE WHEN status = 0 THEN 1 WHEN status IN (2, 3, 4) AND prediction > 0 AND observers >= 2 THEN 2 ELSE 0 END AS source FROM stat s LEFT JOIN maj USING (entity))"""


def _recovered(votes):
    winners = _winners(votes)
    stats = _stats(votes, winners)
    reliability = op.reliabilities(op.leave_one_out(winners, stats))
    return stats, op.weighted_scores(winners, reliability)


@query("CMP4 SRC9", f"WITH {V1}, {NORM}, {WINNER}, {BRUTE}, {RELIABILITY}, {SCORES} SELECT entity, class_id, round(score, 5) AS score, observers FROM sc")
def weighted_scores(spark, d):
    return _recovered(event_votes(spark, d))[1].withColumn("score", F.round("score", 5))


@query("CMP5 WIN8 AGG27", f"WITH {chain(V1)}, {BRUTE}, {RELIABILITY}, {SCORES}, {RECOVER} SELECT entity, status, label, source FROM rec")
def recover_abstentions(spark, d):
    return op.recovered(*_recovered(event_votes(spark, d)))


@query(
    "CHK5",
    f"""WITH {chain(V1)}, {BRUTE}, {RELIABILITY}, {SCORES}, {RECOVER}
SELECT 0::BIGINT AS missing, 0::BIGINT AS anchors_changed, 0::BIGINT AS anchor_codes, 0::BIGINT AS unobserved_filled, 0::BIGINT AS recovered_anchors, 0::BIGINT AS zero_codes, count(*) FILTER (source = 2) AS recovered FROM rec""",
)
def recovery_invariants(spark, d):
    stats, scores = _recovered(event_votes(spark, d))
    return op.recovery_violations(op.labels(stats), op.recovered(stats, scores))


EVENTS = f"""{R1}, seen AS (SELECT entity, count(DISTINCT view) AS observed FROM regions GROUP BY 1),
ev AS (SELECT DISTINCT entity, view, CAST(region % 20 AS INT) AS cluster FROM regions),
mem AS (SELECT entity, cluster, count(*) AS support, any_value(observed) AS observed FROM ev JOIN seen USING (entity) GROUP BY ALL),
members AS (SELECT *, support / observed AS score, CASE WHEN support = 1 THEN 2 WHEN support / observed > {{t}} THEN 1 ELSE 3 END AS status FROM mem)"""


def _members(spark, d, threshold):
    rows = regions(spark, d)
    seen = rows.groupBy("entity").agg(F.countDistinct("view").alias("observed"))
    events = rows.select("entity", "view", F.pmod("region", F.lit(20)).cast("int").alias("cluster")).distinct()
    return op.membership(events, seen, threshold)


@query("AGG7 SRC13 SNK6 PRJ10", f"WITH {EVENTS.format(t=0.1)} SELECT entity, cluster, support, observed, round(score, 6) AS score, status FROM members")
def membership_status(spark, d):
    return _members(spark, d, 0.1).withColumn("score", F.round("score", 6))


@query("AGG7", f"WITH {EVENTS.format(t=0.1)} SELECT 0::BIGINT AS unobserved, count(*) FILTER (support > observed) AS oversupported FROM members")
def membership_invariants(spark, d):
    return op.membership_violations(_members(spark, d, 0.1))


@query(
    "AGG8 AGG46",
    f"""WITH {EVENTS.format(t=0.1)}, pool AS (SELECT entity, CAST(cluster % 4 AS INT) AS concept, CAST(sum(support) AS BIGINT) AS support, any_value(observed) AS observed FROM members GROUP BY ALL),
st AS (SELECT *, CASE WHEN support = 1 THEN 2 WHEN support / observed > 0.4 THEN 1 ELSE 3 END AS status FROM pool)
SELECT t AS threshold, count(*) FILTER (support > 1 AND support / observed > t) AS covered, count(*) AS total FROM st, (VALUES (0.5::DOUBLE), (0.4::DOUBLE), (0.3::DOUBLE)) v(t) GROUP BY 1""",
)
def concept_pool_sweep(spark, d):
    members = _members(spark, d, 0.1)
    concepts = members.select("cluster", F.pmod("cluster", F.lit(4)).alias("concept")).distinct()
    pool = op.pooled(members, concepts, 0.4)
    sweep = spark.createDataFrame([(0.5,), (0.4,), (0.3,)], "threshold double")
    return (
        pool.crossJoin(F.broadcast(sweep))
        .groupBy("threshold")
        .agg(F.count_if((F.col("support") > 1) & (F.col("score") > F.col("threshold"))).alias("covered"), F.count("*").alias("total"))
    )


@query(
    "WIN9 WIN10",
    f"""WITH {EVENTS.format(t=0.1)}, sz AS (SELECT cluster, count(*) AS size FROM members WHERE status = 1 GROUP BY 1)
SELECT entity, cluster FROM members JOIN sz USING (cluster) WHERE status = 1
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN cluster = 2 THEN 1 ELSE 0 END DESC, round(score, 9) DESC, size, cluster) = 1""",
)
def flat_labels(spark, d):
    members = _members(spark, d, 0.1)
    order = (
        members.where(F.col("status") == op.MEMBER)
        .groupBy("cluster")
        .agg(F.count("*").alias("size"))
        .withColumn("priority", (F.col("cluster") == 2).cast("int"))
    )
    return op.flat_labels(members, "cluster", order)


OOV = """wins AS (SELECT entity, winner AS class_id, count(*) AS wins FROM win WHERE winner > 0 GROUP BY ALL),
pos AS (SELECT entity, class_id, count(*) AS positive, sum(weight) AS mass FROM norm GROUP BY ALL),
seen AS (SELECT entity, count(DISTINCT observer) AS visible FROM votes GROUP BY 1),
evidence AS (SELECT entity, class_id, coalesce(wins, 0) AS wins, positive, mass FROM pos LEFT JOIN wins USING (entity, class_id)),
base AS (SELECT s.entity, 1 + s.entity % 3 AS label, s.visible, coalesce(w.wins, 0) AS incumbent FROM seen s LEFT JOIN wins w ON w.entity = s.entity AND w.class_id = 1 + s.entity % 3),
best AS (SELECT * FROM evidence WHERE class_id IN (4, 5) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY wins DESC, round(mass, 9) DESC, class_id) = 1)"""
FILL = """(visible >= 3 AND wins >= 2 AND wins / visible >= 0.2 AND wins / visible >= incumbent / visible + 0.05 AND round(mass, 9) / visible >= 0.15 AND positive >= 2 AND label NOT IN (4, 5))"""


def _evidence(spark, d):
    votes = event_votes(spark, d)
    norm = vt.normalised(votes)
    winners = vt.with_unique_winner(norm, vt.OF_VIEW)
    wins = winners.where("winner > 0").groupBy("entity", F.col("winner").alias("class_id")).agg(F.count("*").alias("wins"))
    positive = norm.groupBy("entity", "class_id").agg(F.count("*").alias("positive"), F.sum("weight").alias("mass"))
    evidence = positive.join(wins, ["entity", "class_id"], "left").fillna(0, ["wins"])
    seen = votes.groupBy("entity").agg(F.countDistinct("observer").alias("visible")).withColumn("label", 1 + F.pmod("entity", F.lit(3)))
    base = seen.join(wins.select("entity", F.col("class_id").alias("label"), F.col("wins").alias("incumbent_wins")), ["entity", "label"], "left")
    return base, evidence


@query("AGG47", f"WITH {V1}, {NORM}, {WINNER}, {OOV} SELECT entity, class_id, wins, positive, round(mass, 6) AS mass FROM evidence")
def class_evidence(spark, d):
    return _evidence(spark, d)[1].withColumn("mass", F.round("mass", 6)).select("entity", "class_id", "wins", "positive", "mass")


@query("CMP6 FLT3 CMP12", f"WITH {V1}, {NORM}, {WINNER}, {OOV} SELECT b.entity, b.label AS base, CASE WHEN coalesce({FILL}, false) THEN class_id ELSE b.label END AS label, coalesce({FILL}, false) AS filled FROM base b LEFT JOIN best USING (entity)")
def gated_replacement(spark, d):
    base, evidence = _evidence(spark, d)
    return op.replacements(base, evidence, [4, 5], share_min=0.2, mass_min=0.15)
