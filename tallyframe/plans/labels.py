"""Label algebra, group filters, claims and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import consensus as cs
from ..operators import labels as op
from ..operators import votes as vt
from ..sources.encodings import R1, V1, V2, event_votes, order_votes, regions, table
from .consensus import chain
from .registry import query
from .votes import NORM, WINNER

BASE = "base AS (SELECT p_partkey AS entity, CAST(1 + p_partkey % 6 AS INT) AS label FROM part)"
EXT = "ext AS (SELECT p_partkey AS entity, CAST(CASE WHEN p_partkey % 3 = 0 THEN 11 + p_partkey % 5 ELSE 0 END AS INT) AS extension FROM part)"
PROPS = f"{R1}, props AS (SELECT region, view AS frame, concept, CAST(region % 20 AS INT) AS grp, CAST((region * 7) % 100 AS DOUBLE) / 100 AS score, entity, weight FROM regions)"


def _base(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity"), (1 + F.pmod("p_partkey", F.lit(6))).cast("int").alias("label"))


def _ext(spark, d):
    value = F.when(F.pmod("p_partkey", F.lit(3)) == 0, 11 + F.pmod("p_partkey", F.lit(5))).otherwise(F.lit(0)).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity"), value.alias("extension"))


def _props(spark, d):
    return regions(spark, d).select(
        "region",
        F.col("view").alias("frame"),
        "concept",
        F.pmod("region", F.lit(20)).cast("int").alias("grp"),
        (F.pmod(F.col("region") * 7, F.lit(100)).cast("double") / 100).alias("score"),
        "entity",
        "weight",
    )


#: Extension classes 13, then 11 and 12 together, get the ids after the base's.
IDS = [(13, 7, 1), (11, 8, 2), (12, 8, 2)]
MERGED = "merged AS (SELECT entity, label AS base, CASE extension WHEN 13 THEN 7 WHEN 11 THEN 8 WHEN 12 THEN 8 ELSE label END AS label FROM base JOIN ext USING (entity))"


def _merged(spark, d):
    ids = spark.createDataFrame(IDS, "extension int, new int, place int")
    return op.merged(_base(spark, d), _ext(spark, d), ids)


@query("CMP11 SET9 X41", f"WITH {BASE}, {EXT}, {MERGED} SELECT * FROM merged")
def override_merge(spark, d):
    return _merged(spark, d)


@query("AGG16", f"WITH {BASE}, {EXT}, {MERGED} SELECT base, label, count(*) AS n FROM merged WHERE base <> label GROUP BY ALL")
def label_transitions(spark, d):
    return op.transitions(_merged(spark, d))


@query("AGG15 AGG21", f"WITH {BASE}, {EXT}, {MERGED} SELECT label, count(*) AS n FROM merged GROUP BY 1")
def label_histogram(spark, d):
    return _merged(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("AGG45", "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return op.confusion(table(spark, d, "labels"), "quality", "toxic").withColumn("share", F.round("share", 6))


@query("AGG45", f"WITH {BASE}, {EXT}, {MERGED} SELECT base, label, count(*) AS n FROM merged WHERE base <> label GROUP BY ALL ORDER BY n DESC, base, label LIMIT 8")
def top_confusions(spark, d):
    return op.transitions(_merged(spark, d)).orderBy(F.desc("n"), "base", "label").limit(8)


SIGNED = "signed AS (SELECT concept, entity, count(DISTINCT frame) FILTER (weight >= 25) AS positive, count(DISTINCT frame) FILTER (weight < 25) AS negative FROM props GROUP BY ALL)"


def _signed(spark, d):
    return _props(spark, d).groupBy("concept", "entity").agg(
        F.countDistinct(F.when(F.col("weight") >= 25, F.col("frame"))).alias("positive"),
        F.countDistinct(F.when(F.col("weight") < 25, F.col("frame"))).alias("negative"),
    )


@query("AGG20 AGG19 SNK8 SRC12", f"WITH {PROPS}, {SIGNED} SELECT * FROM signed")
def signed_evidence(spark, d):
    return _signed(spark, d)


CLAIMS = f"{PROPS}, {SIGNED}, robust AS (SELECT concept, entity FROM signed WHERE positive >= 2 AND positive / greatest(positive + negative, 1) >= 0.5)"


def _claims(spark, d):
    signed = _signed(spark, d)
    return op.signed_gate(signed.select("concept", "entity"), signed, ["concept", "entity"], 2, 0.5)


@query("FLT4 FLT8 MTH32", f"WITH {CLAIMS} SELECT * FROM robust")
def signed_gate(spark, d):
    return _claims(spark, d)


@query("AGG13", f"WITH {CLAIMS}, n AS (SELECT p_partkey AS entity, count(concept) AS claims FROM part LEFT JOIN robust ON entity = p_partkey GROUP BY 1) SELECT count(*) FILTER (claims = 0) AS unclaimed, count(*) FILTER (claims = 1) AS single, count(*) FILTER (claims > 1) AS ambiguous FROM n")
def claim_partition(spark, d):
    counts = _claims(spark, d).groupBy("entity").agg(F.count("*").alias("claims"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("entity")).join(counts, "entity", "left").fillna(0, ["claims"])
    return n.agg(F.count_if(F.col("claims") == 0).alias("unclaimed"), F.count_if(F.col("claims") == 1).alias("single"), F.count_if(F.col("claims") > 1).alias("ambiguous"))


@query("WIN22 SET5 X19", f"WITH {CLAIMS} SELECT entity, min(concept) AS concept FROM robust GROUP BY 1 HAVING count(DISTINCT concept) = 1")
def exclusive_fill(spark, d):
    return op.exclusive(_claims(spark, d), "concept")


@query(
    "AGG14 X4 JN21 FLT5",
    f"""WITH {CLAIMS}, {BASE}, tot AS (SELECT concept, count(*) AS total FROM robust GROUP BY 1), sz AS (SELECT label, count(*) AS size FROM base GROUP BY 1),
c AS (SELECT concept, label % 3 AS class_id, label, count(*) AS overlap FROM robust JOIN base USING (entity) WHERE label % 3 <> concept % 3 GROUP BY ALL),
r AS (SELECT *, sum(overlap) OVER (PARTITION BY concept, class_id) AS class_overlap FROM c),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY concept ORDER BY class_overlap DESC, class_id, overlap DESC, label) = 1)
SELECT concept AS candidate, class_id AS competing_class, round(class_overlap / total, 6) AS class_fraction, label AS competing_label, round(overlap / size, 6) AS coverage,
  round(class_overlap / total * (1 - overlap / size), 6) AS risk FROM tot JOIN b USING (concept) JOIN sz USING (label)""",
)
def competing_risk(spark, d):
    base = _base(spark, d)
    classes = base.select("label").distinct().withColumn("class_id", F.pmod("label", F.lit(3)))
    candidates = _claims(spark, d).select(F.col("concept").alias("candidate"), F.pmod("concept", F.lit(3)).alias("target"), "entity")
    out = op.competing(candidates, base, classes)
    return out.withColumns({c: F.round(c, 6) for c in ("class_fraction", "coverage", "risk")})


OWN = "sup AS (SELECT entity, grp AS cluster, concept AS class_id, count(DISTINCT frame) AS n FROM props GROUP BY ALL)"


def _support(spark, d):
    return _props(spark, d).groupBy("entity", F.col("grp").alias("cluster"), F.col("concept").alias("class_id")).agg(F.countDistinct("frame").alias("n"))


@query("WIN18 WIN19", f"WITH {PROPS}, {OWN}, t AS (SELECT *, max(n) OVER (PARTITION BY entity) AS m FROM sup) SELECT entity, CASE WHEN count(DISTINCT class_id) = 1 THEN min(cluster) ELSE 0 END AS owner, max(n) AS n FROM t WHERE n = m GROUP BY 1")
def ownership_max_support(spark, d):
    return op.owners(_support(spark, d))


@query("WIN21", f"WITH {PROPS}, c AS (SELECT entity, grp AS cluster, concept AS class_id, max(score) AS score FROM props GROUP BY ALL) SELECT entity, CASE WHEN count(DISTINCT class_id) = 1 THEN CAST(arg_max(cluster, struct_pack(s := round(score, 9), c := -cluster)) AS INT) ELSE 0 END AS cluster FROM c GROUP BY 1")
def component_conflicts(spark, d):
    claims = _props(spark, d).groupBy("entity", F.col("grp").alias("cluster"), F.col("concept").alias("class_id")).agg(F.max("score").alias("score"))
    return op.unconflicted(claims)


def _counts(votes):
    return cs.winner_counts(vt.with_unique_winner(vt.normalised(votes), vt.OF_VIEW))


PLUR = "pl AS (SELECT entity, CASE WHEN count(*) = 1 AND max(total) >= 2 THEN min(class_id) ELSE 0 END AS label, CAST(max(total) AS BIGINT) AS total FROM (SELECT *, max(n) OVER (PARTITION BY entity) AS m, sum(n) OVER (PARTITION BY entity) AS total FROM counts) WHERE n = m GROUP BY 1)"


@query("WIN17 AGG36", f"WITH {chain(V2)}, {PLUR} SELECT * FROM pl")
def plurality_labels(spark, d):
    return op.plurality(_counts(order_votes(spark, d)), 2)


@query(
    "WIN15 WIN16 X13",
    f"""WITH {chain(V2)}, soft AS (SELECT entity, class_id AS soft FROM (SELECT entity, class_id, sum(weight) AS w FROM norm GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(w, 9) DESC, class_id) = 1)
SELECT entity, CASE WHEN status = 0 AND winner = soft THEN winner ELSE 0 END AS label, CASE WHEN status <> 0 THEN 'no_majority' WHEN winner <> soft THEN 'disagree' ELSE 'accepted' END AS reason FROM stat JOIN soft USING (entity)""",
)
def hard_soft_agreement(spark, d):
    votes = order_votes(spark, d)
    norm = vt.normalised(votes)
    stats = cs.statistics(cs.winner_counts(vt.with_unique_winner(norm, vt.OF_VIEW)), votes)
    sums = norm.groupBy("entity", "class_id").agg(F.round(F.sum("weight"), 9).alias("w"))
    soft = vt.smallest_winner(sums, ["entity"], "w").select("entity", F.col("winner").alias("soft"))
    agreed = (F.col("status") == cs.ACCEPTED) & (F.col("winner") == F.col("soft"))
    reason = F.when(F.col("status") != cs.ACCEPTED, "no_majority").when(~agreed, "disagree").otherwise("accepted")
    return stats.join(soft, "entity").select("entity", F.when(agreed, F.col("winner")).otherwise(0).alias("label"), reason.alias("reason"))


@query("SET6", f"WITH {EXT}, {BASE} SELECT entity, CASE WHEN coalesce(extension, 0) > 0 THEN extension ELSE coalesce(label, 0) END AS label, CASE WHEN coalesce(extension, 0) > 0 THEN 2 WHEN coalesce(label, 0) > 0 THEN 1 ELSE 0 END AS source FROM (SELECT * FROM base WHERE entity % 2 = 0) FULL JOIN (SELECT * FROM ext WHERE entity % 4 < 2) USING (entity)")
def seed_union(spark, d):
    j = _base(spark, d).where("entity % 2 = 0").join(_ext(spark, d).where("entity % 4 < 2"), "entity", "full")
    component, region = F.coalesce("extension", F.lit(0)), F.coalesce("label", F.lit(0))
    return j.select(
        "entity",
        F.when(component > 0, component).otherwise(region).alias("label"),
        F.when(component > 0, F.lit(2)).when(region > 0, F.lit(1)).otherwise(F.lit(0)).alias("source"),
    )


@query("SET1 SET2 AGG10", f"WITH {PROPS} SELECT CASE WHEN concept < 2 THEN concept ELSE 100 + grp END AS merged, count(DISTINCT entity) AS size, max(weight) AS best FROM props GROUP BY 1")
def stuff_merge(spark, d):
    key = F.when(F.col("concept") < 2, F.col("concept")).otherwise(100 + F.col("grp"))
    support = _props(spark, d).groupBy(key.alias("merged"), "entity").agg(F.max("weight").alias("weight"))
    return support.groupBy("merged").agg(F.count("*").alias("size"), F.max("weight").alias("best"))


@query("AGG29 AGG30", f"WITH {PROPS}, f AS (SELECT grp, frame, max(score) AS score, count(DISTINCT entity) AS size FROM props GROUP BY ALL) SELECT grp, count(*) AS frames, round(sum(score), 6) AS score, CAST(sum(size) AS BIGINT) AS supports FROM f GROUP BY 1")
def group_frame_supports(spark, d):
    f = _props(spark, d).groupBy("grp", "frame").agg(F.max("score").alias("score"), F.countDistinct("entity").alias("size"))
    return f.groupBy("grp").agg(F.count("*").alias("frames"), F.round(F.sum("score"), 6).alias("score"), F.sum("size").alias("supports"))


@query("AGG31 AGG34 AGG35 AGG43 X11", f"WITH {PROPS}, t AS (SELECT grp, count(DISTINCT frame) AS frames FROM props GROUP BY 1) SELECT grp, entity, count(DISTINCT frame) AS observers, round(sum(score) / any_value(frames), 6) AS support, bit_or(1::BIGINT << frame) AS observer_bits FROM props JOIN t USING (grp) GROUP BY ALL")
def component_support(spark, d):
    props = _props(spark, d)
    frames = props.groupBy("grp").agg(F.countDistinct("frame").alias("frames"))
    return (
        props.join(frames, "grp")
        .groupBy("grp", "entity")
        .agg(
            F.countDistinct("frame").alias("observers"),
            F.round(F.sum("score") / F.first("frames"), 6).alias("support"),
            F.bit_or(F.expr("shiftleft(1L, frame)")).alias("observer_bits"),
        )
    )


@query("AGG36 X2", f"WITH {PROPS} SELECT concept, entity, count(DISTINCT frame) AS views FROM props GROUP BY ALL HAVING count(DISTINCT frame) >= 8")
def multiview_seeds(spark, d):
    return _props(spark, d).groupBy("concept", "entity").agg(F.countDistinct("frame").alias("views")).where("views >= 8")


ASSIGN = """fs AS (SELECT grp, frame, greatest(max(score), 1e-6) AS score FROM props GROUP BY ALL), ft AS (SELECT grp, sum(score) AS total, count(*) AS views FROM fs GROUP BY 1),
ev AS (SELECT grp, entity, sum(f.score) / any_value(total) * any_value(views) / (any_value(views) + 2.0) AS evidence FROM (SELECT DISTINCT grp, frame, entity FROM props) JOIN fs f USING (grp, frame) JOIN ft USING (grp) GROUP BY ALL),
assigned AS (SELECT entity, grp, round(evidence + (grp % 3) * 1e-7, 9) AS quality FROM ev WHERE round(evidence, 9) >= 0.2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY quality DESC, grp) = 1)"""


def _assigned(spark, d):
    return op.assigned(_props(spark, d), F.pmod("grp", F.lit(3)), 2.0, 0.2)


@query("CMP8", f"WITH {PROPS}, {ASSIGN} SELECT entity, grp, round(quality, 6) AS quality FROM assigned")
def evidence_assignment(spark, d):
    return _assigned(spark, d).withColumn("quality", F.round("quality", 6))


@query(
    "CMP9 CMP14 MTH8 X34 TOP13 TOP14 X12",
    f"""WITH {PROPS}, {ASSIGN}, g AS (SELECT grp, count(*) AS size FROM assigned GROUP BY 1), v AS (SELECT grp, count(DISTINCT frame) AS views FROM props GROUP BY 1),
m AS (SELECT grp, size, CASE WHEN grp % 2 = 0 OR views / 25.0 >= 0.2 THEN CAST(ceil((CASE WHEN grp % 2 = 0 THEN 60 ELSE 80 END) * greatest(0.5, 1 - views / 25.0 / 2)) AS BIGINT) ELSE 80 END AS minimum FROM g JOIN v USING (grp))
SELECT grp, size, minimum, size >= minimum AS kept, CAST(CASE WHEN size >= minimum THEN row_number() OVER (PARTITION BY size >= minimum ORDER BY grp % 4, grp) ELSE 0 END AS INT) AS id FROM m""",
)
def prune_groups(spark, d):
    views = _props(spark, d).groupBy("grp").agg(F.countDistinct("frame").alias("views"))
    sizes = _assigned(spark, d).groupBy("grp").agg(F.count("*").alias("size")).join(views, "grp")
    minimum = op.adaptive_minimum(F.col("views"), 25, 10, F.pmod("grp", F.lit(2)) == 0, 60, 80, 0.2, 0.5)
    rows = sizes.select("grp", "size", minimum.alias("minimum")).withColumn("kept", F.col("size") >= F.col("minimum"))
    kept = op.renumbered(rows.where("kept"), [F.pmod("grp", F.lit(4)), F.col("grp")])
    return kept.unionByName(rows.where("not kept").withColumn("id", F.lit(0)))


GROUPS = "g AS (SELECT grp, any_value(concept) AS concept, count(DISTINCT entity) AS size, count(DISTINCT region) AS proposals, max(score) AS score FROM props GROUP BY 1)"


def _groups(spark, d):
    return _props(spark, d).groupBy("grp").agg(
        F.first("concept").alias("concept"), F.countDistinct("entity").alias("size"), F.countDistinct("region").alias("proposals"), F.max("score").alias("score")
    )


@query(
    "TOP1 TOP2 X24 STR21",
    f"""WITH {PROPS}, {GROUPS}, k AS (SELECT grp, concept, CAST(row_number() OVER (ORDER BY concept >= 2 DESC, concept DESC, score DESC, proposals DESC, size DESC, grp) AS INT) AS id FROM g WHERE size >= 10 AND proposals >= 2 ORDER BY id LIMIT 12)
SELECT grp, id, CASE WHEN concept < 2 THEN 'class' || concept ELSE 'class' || concept || '_' || lpad(CAST(row_number() OVER (PARTITION BY concept ORDER BY id) AS VARCHAR), 2, '0') END AS name FROM k""",
)
def ranked_groups(spark, d):
    order = [(F.col("concept") >= 2).desc(), F.desc("concept"), F.desc("score"), F.desc("proposals"), F.desc("size"), F.col("grp")]
    kept = op.renumbered(_groups(spark, d).where("size >= 10 and proposals >= 2"), order).where("id <= 12")
    ordinal = F.row_number().over(Window.partitionBy("concept").orderBy("id"))
    stem = F.concat(F.lit("class"), F.col("concept"))
    name = F.when(F.col("concept") < 2, stem).otherwise(F.concat(stem, F.lit("_"), F.lpad(ordinal.cast("string"), 2, "0")))
    return kept.select("grp", "id", name.alias("name"))


@query("TOP12", f"WITH {PROPS}, f AS (SELECT grp, any_value(concept) AS concept, min(frame * 1000000 + region) AS k FROM props GROUP BY 1) SELECT grp, CAST(k // 1000000 AS INT) AS first_view, k % 1000000 AS first_region, CAST(row_number() OVER (ORDER BY concept, k) AS INT) AS id FROM f")
def cluster_registry(spark, d):
    first = _props(spark, d).groupBy("grp").agg(F.first("concept").alias("concept"), F.min(F.struct("frame", "region")).alias("k"))
    ids = op.renumbered(first, ["concept", "k"])
    return ids.select("grp", F.col("k.frame").alias("first_view"), F.col("k.region").alias("first_region"), "id")


@query("X23 X22", f"WITH {PROPS} SELECT entity, min(grp) AS grp FROM props GROUP BY 1")
def first_group_wins(spark, d):
    return _props(spark, d).groupBy("entity").agg(F.min("grp").alias("grp"))


@query("SET4", f"WITH {PROPS} SELECT entity, count(DISTINCT frame) AS views FROM props WHERE frame IN (1, 2, 3) AND concept >= 0 GROUP BY 1 HAVING count(DISTINCT frame) = 3")
def confirmed_by_views(spark, d):
    return _props(spark, d).where(F.col("frame").isin(1, 2, 3)).groupBy("entity").agg(F.countDistinct("frame").alias("views")).where("views = 3")


@query("X6 SET3", f"WITH {PROPS}, anchor AS (SELECT DISTINCT entity FROM props WHERE grp = 0) SELECT entity, count(DISTINCT region) AS proposals FROM props WHERE concept = 0 AND grp <> 0 AND entity NOT IN (SELECT entity FROM anchor) GROUP BY 1 HAVING count(DISTINCT region) >= 3")
def extension_entities(spark, d):
    props = _props(spark, d)
    anchor = props.where("grp = 0").select("entity").distinct()
    others = props.where("concept = 0 and grp <> 0").join(anchor, "entity", "left_anti")
    return others.groupBy("entity").agg(F.countDistinct("region").alias("proposals")).where("proposals >= 3")


@query(
    "X21 JSN1 CMP13 X20",
    f"""WITH {BASE}, {EXT}, {MERGED}, n AS (SELECT label, count(*) AS n FROM merged GROUP BY 1)
SELECT id AS label, coalesce(n, 0) AS n, '{{"id":' || id || ',"name":"label_' || lpad(CAST(id AS VARCHAR), 2, '0') || '","entity_count":' || coalesce(n, 0) || '}}' AS entry FROM (SELECT unnest(range(0, 10)) AS id) LEFT JOIN n ON n.label = id""",
)
def label_map(spark, d):
    ids = spark.range(0, 10).select(F.col("id").alias("label"))
    counts = _merged(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    rows = ids.join(counts, "label", "left").fillna(0, ["n"])
    entry = F.to_json(F.struct(F.col("label").alias("id"), F.concat(F.lit("label_"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("name"), F.col("n").alias("entity_count")))
    return rows.select("label", "n", entry.alias("entry"))


@query(
    "CMP7",
    f"""WITH {BASE}, m AS (SELECT max(label) AS top FROM base), want(name, explicit) AS (VALUES ('a', 3), ('b', 30), ('c', NULL), ('d', NULL))
SELECT name, CAST(coalesce(explicit, (SELECT top FROM m) + row_number() OVER (PARTITION BY explicit IS NULL ORDER BY name)) AS INT) AS id FROM want""",
)
def id_allocation(spark, d):
    want = spark.createDataFrame([("a", 3), ("b", 30), ("c", None), ("d", None)], "name string, explicit int")
    top = _base(spark, d).agg(F.max("label").alias("top"))
    place = F.row_number().over(Window.partitionBy(F.col("explicit").isNull()).orderBy("name"))
    return want.crossJoin(F.broadcast(top)).select("name", F.coalesce("explicit", F.col("top") + place).cast("int").alias("id"))


@query("X42 X43 SRC19 X40", "SELECT * FROM (VALUES ('wall', 3, true), ('floor', 2, true), ('piano', 1, false)) t(class, priority, stuff)")
def assignment_priorities(spark, d):
    names = spark.createDataFrame([(["wall", "floor", "piano"], ["floor", "wall"])], "classes array<string>, stuff array<string>")
    rows = names.select(F.posexplode("classes").alias("place", "class"), F.size("classes").alias("n"), "stuff")
    return rows.select("class", (F.col("n") - F.col("place")).alias("priority"), F.array_contains("stuff", F.col("class")).alias("stuff"))


@query(
    "X25 CMP23 CHK17 SNK12",
    f"""WITH {BASE}, {EXT}, {MERGED}, n AS (SELECT label, count(*) AS n FROM merged GROUP BY 1), review(label, final_id, status) AS (VALUES (1, 1, 'keep'), (2, 1, 'merge'), (8, 0, 'drop'), (99, 5, 'keep'))
SELECT coalesce(n.label, review.label) AS label, coalesce(n, 0) AS n, coalesce(final_id, n.label) AS final_id, coalesce(status, 'unreviewed') AS status, n.label IS NULL AS unmapped FROM n FULL JOIN review ON n.label = review.label""",
)
def review_sheet(spark, d):
    review = spark.createDataFrame([(1, 1, "keep"), (2, 1, "merge"), (8, 0, "drop"), (99, 5, "keep")], "label int, final_id int, status string")
    counts = _merged(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    j = counts.join(review, "label", "full")
    return j.select(
        "label",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("final_id", "label").alias("final_id"),
        F.coalesce("status", F.lit("unreviewed")).alias("status"),
        F.col("n").isNull().alias("unmapped"),
    )


@query("CMP19 X18 FLT5", f"WITH {CLAIMS}, {BASE}, s AS (SELECT concept, count(*) FILTER (label % 3 = concept % 3) / count(*) AS same, count(*) FILTER (label % 3 <> concept % 3) / count(*) AS other FROM robust JOIN base USING (entity) GROUP BY 1) SELECT concept, round(same, 6) AS same, round(other, 6) AS other, concat_ws(',', CASE WHEN same < 0.33 THEN 'few_of_class' END, CASE WHEN other > 0.66 THEN 'competing' END) AS reasons FROM s")
def seed_policy(spark, d):
    j = _claims(spark, d).join(_base(spark, d), "entity")
    own = F.pmod("label", F.lit(3)) == F.pmod("concept", F.lit(3))
    s = j.groupBy("concept").agg((F.count_if(own) / F.count("*")).alias("same"), (F.count_if(~own) / F.count("*")).alias("other"))
    reasons = F.array_compact(F.array(F.when(F.col("same") < 0.33, "few_of_class"), F.when(F.col("other") > 0.66, "competing")))
    return s.select("concept", F.round("same", 6).alias("same"), F.round("other", 6).alias("other"), F.array_join(reasons, ",").alias("reasons"))


@query("TOP21", f"WITH {PROPS}, {GROUPS} SELECT grp, proposals, CAST(row_number() OVER (ORDER BY score DESC, size DESC, grp) AS INT) AS place FROM g WHERE proposals <= 5")
def few_view_groups(spark, d):
    """Groups of hardly any proposals, by score and size."""
    kept = _groups(spark, d).where("proposals <= 5")
    return op.renumbered(kept, [F.desc("score"), F.desc("size"), F.col("grp")]).select("grp", "proposals", F.col("id").alias("place"))


@query(
    "X35",
    f"""WITH {PROPS}, g AS (SELECT grp, any_value(concept) AS concept, count(DISTINCT entity) AS size, max(score) AS reliability, string_agg(DISTINCT CAST(frame AS VARCHAR), ',' ORDER BY CAST(frame AS VARCHAR)) AS frames FROM props GROUP BY 1)
SELECT concept, CAST(sum(size) AS BIGINT) AS size, round(sum(reliability * size) / sum(size), 6) AS reliability, count(*) AS sources FROM g GROUP BY 1""",
)
def merged_group_records(spark, d):
    g = _props(spark, d).groupBy("grp").agg(F.first("concept").alias("concept"), F.countDistinct("entity").alias("size"), F.max("score").alias("reliability"))
    weighted = F.sum(F.col("reliability") * F.col("size")) / F.sum("size")
    return g.groupBy("concept").agg(F.sum("size").alias("size"), F.round(weighted, 6).alias("reliability"), F.count("*").alias("sources"))
