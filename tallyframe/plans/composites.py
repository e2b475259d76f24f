"""Operators made of others: assembled labels, vocabularies, anchor extensions and completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as op
from ..operators import spatial as sp
from ..operators.greedy import within_budget
from ..sources.encodings import table
from .registry import query
from .spatial import SIZE, _sparse, sparse_chain
from .vectors import E, SOFT, _soft

ENTRIES = [(0, "unlabeled", 0), (1, "class1", 1), (2, "class2", 2), (7, "class7_01", 7)]
THINGS = "AND a.label = b.label"


def _assembled(spark, d):
    kinds = spark.createDataFrame([(k, f"class{k}", k < 5) for k in range(1, 10)], "class_id int, name string, stuff boolean")
    entries = spark.createDataFrame(ENTRIES, "id int, name string, class_id int")
    return op.assembled(_sparse(spark, d).select("entity", F.col("label").alias("class_id"), "x", "y", "z"), kinds, entries, SIZE, 2)


ASSEMBLE = f"""WITH RECURSIVE {sparse_chain('label,', THINGS)},
st AS (SELECT label AS class_id, min(entity) AS component, count(*) AS size FROM points WHERE label BETWEEN 1 AND 4 GROUP BY 1),
th AS (SELECT label AS class_id, component, count(*) AS size FROM members WHERE label >= 5 GROUP BY ALL HAVING count(*) >= 2),
al AS (SELECT *, true AS stuff FROM st UNION ALL SELECT *, false FROM th), fresh AS (SELECT *, 7 + row_number() OVER (ORDER BY class_id, component) AS id, row_number() OVER (PARTITION BY class_id ORDER BY component) + CASE WHEN class_id = 7 THEN 1 ELSE 0 END AS ordinal FROM al WHERE class_id NOT IN (1, 2)),
done AS (SELECT CAST(id AS INT) AS id, CASE WHEN stuff THEN 'class' || class_id ELSE 'class' || class_id || '_' || lpad(CAST(ordinal AS VARCHAR), 2, '0') END AS name, class_id, component, size, stuff, false AS merged FROM fresh
  UNION ALL SELECT class_id, 'class' || class_id, class_id, component, size, true, true FROM al WHERE class_id IN (1, 2))"""


@query("CMP12 CMP13 GR14 STR21", f"{ASSEMBLE} SELECT id, name, class_id, size, merged FROM done")
def assembled_entries(spark, d):
    return _assembled(spark, d)[1]


@query("CMP12 GR14", f"{ASSEMBLE}, lab AS (SELECT p.entity, d.id FROM points p JOIN done d ON d.class_id = p.label AND d.stuff UNION ALL SELECT m.entity, d.id FROM members m JOIN done d ON NOT d.stuff AND d.class_id = m.label AND d.component = m.component) SELECT id AS label, count(*) AS n FROM lab GROUP BY 1")
def assembled_labels(spark, d):
    return _assembled(spark, d)[0].groupBy("label").agg(F.count("*").alias("n"))


def _records(spark, d):
    return table(spark, d, "part").groupBy(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("class")).agg(F.count("*").alias("size"), F.countDistinct("p_brand").alias("views"))


RECORDS = "rec AS (SELECT lower(replace(p_type, ' ', '_')) AS class, count(*) AS size, count(DISTINCT p_brand) AS views FROM part GROUP BY 1)"


@query(
    "CMP16 AGG26 CHK14",
    f"""WITH {RECORDS}, ont AS (SELECT class, CASE WHEN size % 2 = 0 THEN 'stuff' ELSE 'thing' END AS kind FROM rec WHERE views >= 20), j AS (SELECT r.class, r.size, r.views, kind, concat_ws(',', CASE WHEN kind IS NULL THEN 'not_in_ontology' END, CASE WHEN size < 310 THEN 'size' END, CASE WHEN views < 25 THEN 'views' END) AS reasons FROM rec r LEFT JOIN ont USING (class))
SELECT class, reasons, CASE WHEN class = (SELECT min(class) FROM rec) THEN 'first one,' ELSE '' END || replace(class, '_', ' ') AS prompts, CAST(CASE WHEN reasons = '' THEN row_number() OVER (PARTITION BY reasons = '' ORDER BY kind = 'stuff', size DESC, class) ELSE 0 END AS INT) AS priority FROM j""",
)
def refinement_vocabulary(spark, d):
    records = _records(spark, d)
    ontology = records.where("views >= 20").select("class", F.when(F.pmod("size", F.lit(2)) == 0, "stuff").otherwise("thing").alias("kind"))
    aliases = records.agg(F.min("class").alias("class")).select("class", F.lit(0).alias("place"), F.lit("First  one").alias("prompt"))
    out = op.eligible(records, ontology, aliases, 310, 25)
    return out.select("class", F.array_join("reasons", ",").alias("reasons"), F.array_join("prompts", ",").alias("prompts"), "priority")


SPECS = [("metal", 0, ["steel", "brass plate"]), ("wooden_thing", 1, ["promo", "standard"]), ("window", 2, ["window shutter"])]


@query("CMP15 CMP17 SRC19 JN11 STR13", None)
def guard_vocabulary(spark, d):
    """Existing classes matched to scene specs or kept under their names, within a budget of prompt words; extensions always."""
    specs = spark.createDataFrame(SPECS, "class string, place int, prompts array<string>")
    v = op.guards(_records(spark, d), specs, ["window"])
    words = F.size(F.array_distinct(F.flatten(F.transform("prompts", lambda p: F.split(p, " ")))))
    items = v.where("role = 'guard'").select(F.col("class").alias("item"), F.lit(True).alias("thing"), "size", words.alias("words"))
    kept = within_budget(items, 6).withColumnRenamed("item", "class")
    return v.join(kept, "class", "left").select("class", "role", "size", F.array_join("prompts", "|").alias("prompts"), F.coalesce("kept", F.lit(True)).alias("kept"))


@query("CMP17 CHK14", "SELECT 0::BIGINT AS shared")
def vocabulary_conflicts(spark, d):
    specs = spark.createDataFrame(SPECS, "class string, place int, prompts array<string>")
    return op.shared_prompts(op.guards(_records(spark, d), specs, ["window"])).agg(F.count("*").alias("shared"))


WINNERS = f"{E}, {SOFT}, w AS (SELECT vec_id, label, CAST(list_position(p, list_max(p)) - 1 AS INT) AS winner FROM soft)"
SUPPORT = "sup AS (SELECT vec_id, l_partkey AS entity FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 46) JOIN embeddings ON l_suppkey = vec_id % 10 + 10 * (vec_id // 10 % 10))"


def _proposals(spark, d):
    e = _soft(spark, d).select("vec_id", "label", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("winner"))
    region = F.pmod("vec_id", F.lit(10)) + 10 * F.pmod(F.expr("vec_id div 10"), F.lit(10))
    items = table(spark, d, "lineitem").where("l_quantity >= 46").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("entity")).distinct()
    return e, e.select("vec_id", "label", region.alias("region")).join(items, "region")


@query(
    "GR24 X5 X6",
    f"""WITH {WINNERS}, {SUPPORT}, anc AS (SELECT DISTINCT label, entity FROM sup JOIN w USING (vec_id) WHERE vec_id % 2 = 0),
cls AS (SELECT label, winner AS anchor_class FROM (SELECT label, winner, count(*) AS n FROM w WHERE vec_id % 2 = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, winner) = 1),
cand AS (SELECT vec_id, w.label, winner = anchor_class AS matching FROM w JOIN cls ON cls.label = w.label WHERE vec_id % 2 = 1),
fill AS (SELECT c.label, s.entity FROM cand c JOIN sup s USING (vec_id) LEFT JOIN anc a ON a.label = c.label AND a.entity = s.entity WHERE matching AND a.entity IS NULL GROUP BY ALL HAVING count(DISTINCT c.vec_id) >= 2)
SELECT c.label, count(*) AS attached, count(*) FILTER (matching) AS matching, (SELECT count(*) FROM fill f WHERE f.label = c.label) AS fill, CASE WHEN count(*) - count(*) FILTER (matching) > count(*) FILTER (matching) THEN 'rejected_identity' WHEN (SELECT count(*) FROM fill f WHERE f.label = c.label) < 3 THEN 'rejected_extension' ELSE 'accepted' END AS status FROM cand c GROUP BY c.label""",
)
def anchor_extensions(spark, d):
    """Components by label: proposals of even number anchor it, the others are attached; entities outside the
    anchor in two matching proposals extend it if most attached ones agree on its class."""
    e, support = _proposals(spark, d)
    anchor = F.pmod("vec_id", F.lit(2)) == 0
    counts = e.where(anchor).groupBy("label", "winner").agg(F.count("*").alias("n"))
    cls = counts.groupBy("label").agg(F.max(F.struct("n", (-F.col("winner")).alias("w"))).alias("b")).select("label", (-F.col("b.w")).alias("anchor_class"))
    attached = e.where(~anchor).join(cls, "label").withColumn("matching", F.col("winner") == F.col("anchor_class"))
    inside = support.where(anchor).select("label", "entity").distinct()
    fill = (
        support.join(attached.where("matching").select("vec_id"), "vec_id", "left_semi")
        .join(inside, ["label", "entity"], "left_anti")
        .groupBy("label", "entity")
        .agg(F.countDistinct("vec_id").alias("views"))
        .where("views >= 2")
        .groupBy("label")
        .agg(F.count("*").alias("fill"))
    )
    g = attached.groupBy("label").agg(F.count("*").alias("attached"), F.count_if("matching").alias("matching")).join(fill, "label", "left").fillna(0, ["fill"])
    status = F.when(F.col("attached") - F.col("matching") > F.col("matching"), "rejected_identity").when(F.col("fill") < 3, "rejected_extension").otherwise("accepted")
    return g.withColumn("status", status)


@query(
    "GR26 GR19 X4",
    f"""WITH RECURSIVE {sparse_chain('label,', THINGS)}, g AS (SELECT label, component, count(*) AS size, count(*) FILTER (entity % 5 = 0) AS seeds, count(*) FILTER (entity % 5 <> 0 AND entity % 7 = 0) AS rivals FROM members GROUP BY ALL)
SELECT label, component, size, seeds, size - seeds - rivals AS fill, CASE WHEN seeds = 0 THEN 'no_seed' WHEN rivals / (size - seeds + 0.0) > 0.3 THEN 'competing' WHEN size = seeds THEN 'complete' ELSE 'accepted' END AS status FROM g WHERE size >= 2""".replace("rivals / (size - seeds + 0.0)", "rivals / greatest(size - seeds, 1)"),
)
def partial_completions(spark, d):
    """Components of a dense class that hold seeds of it: what is neither seed nor another instance would complete them."""
    members = sp.voxel_components(_sparse(spark, d), SIZE, ["label"])
    seed, rival = F.pmod("entity", F.lit(5)) == 0, F.pmod("entity", F.lit(7)) == 0
    g = members.groupBy("label", "component").agg(F.count("*").alias("size"), F.count_if(seed).alias("seeds"), F.count_if(~seed & rival).alias("rivals")).where("size >= 2")
    status = (
        F.when(F.col("seeds") == 0, "no_seed")
        .when(F.col("rivals") / F.greatest(F.col("size") - F.col("seeds"), F.lit(1)) > 0.3, "competing")
        .when(F.col("size") == F.col("seeds"), "complete")
        .otherwise("accepted")
    )
    return g.select("label", "component", "size", "seeds", (F.col("size") - F.col("seeds") - F.col("rivals")).alias("fill"), status.alias("status"))


@query(
    "GR25 X14 MTH34 JN19",
    """WITH s AS (SELECT l_suppkey % 20 AS frame, l_linenumber AS region, l_partkey % 40 AS seed, count(*) AS hits FROM lineitem GROUP BY ALL), t AS (SELECT frame, region, sum(hits) AS total FROM s GROUP BY ALL), u AS (SELECT frame, seed, sum(hits) AS all_hits FROM s GROUP BY ALL),
r AS (SELECT frame, region, seed, hits, total, all_hits, hits / all_hits AS coverage, 0.5::DOUBLE * hits / (total + all_hits - hits) + 0.3::DOUBLE * hits / total AS score FROM s JOIN t USING (frame, region) JOIN u USING (frame, seed)),
o AS (SELECT *, row_number() OVER (PARTITION BY frame, region ORDER BY round(score, 9) DESC, seed) AS place FROM r), b AS (SELECT * FROM o WHERE place = 1 AND coverage >= 0.05)
SELECT frame, region, CAST(seed AS BIGINT) AS seed, hits, CAST(total AS BIGINT) AS total, CAST(all_hits AS BIGINT) AS all_hits, round(score + 1e-12::DOUBLE, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY frame, seed ORDER BY round(score, 9) DESC, region) = 1""",
)
def propagated_regions(spark, d):
    """Per frame, each region's best seed that it covers well enough; a seed keeps its best region."""
    from pyspark.sql.window import Window

    s = table(spark, d, "lineitem").groupBy(
        F.pmod("l_suppkey", F.lit(20)).alias("frame"), F.col("l_linenumber").alias("region"), F.pmod("l_partkey", F.lit(40)).alias("seed")
    ).agg(F.count("*").alias("hits"))
    t = s.groupBy("frame", "region").agg(F.sum("hits").alias("total"))
    u = s.groupBy("frame", "seed").agg(F.sum("hits").alias("all_hits"))
    hits = F.col("hits")
    r = s.join(t, ["frame", "region"]).join(u, ["frame", "seed"])
    r = r.withColumn("score", 0.5 * hits / (F.col("total") + F.col("all_hits") - hits) + 0.3 * hits / F.col("total"))
    by_region = Window.partitionBy("frame", "region").orderBy(F.round("score", 9).desc(), "seed")
    by_seed = Window.partitionBy("frame", "seed").orderBy(F.round("score", 9).desc(), "region")
    best = r.withColumn("place", F.row_number().over(by_region)).where("place = 1").where(hits / F.col("all_hits") >= 0.05)
    one = best.withColumn("place", F.row_number().over(by_seed)).where("place = 1")
    # A score on half a unit of the last place would round by its last bit; no score lies just below one.
    return one.select("frame", "region", "seed", "hits", "total", "all_hits", F.round(F.col("score") + 1e-12, 6).alias("score"))
