"""Region overlaps, association, part-of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph
from ..operators import overlap as op
from ..sources.encodings import R1, points, regions
from .registry import query

PAIRS = """prs AS (SELECT l.region AS a, r.region AS b, count(*) AS shared, sum(least(l.weight, r.weight)) AS low FROM regions l JOIN regions r
  ON l.entity = r.entity AND l.region < r.region AND l.concept = r.concept AND l.view <> r.view GROUP BY ALL)"""
TOT = "tot AS (SELECT region, sum(weight) AS weight, count(*) AS size FROM regions GROUP BY 1)"
SIM = """sim AS (SELECT p.a, p.b, shared, shared / (x.size + y.size - shared) AS iou, shared / x.size AS in_a, shared / y.size AS in_b, low / (x.weight + y.weight - low) AS jaccard,
  low / least(x.weight, y.weight) AS weighted_containment FROM prs p JOIN tot x ON x.region = a JOIN tot y ON y.region = b)"""
T = 0.11


def _similar(spark, d, same=True, other=True):
    rows = regions(spark, d)
    return rows, op.similarities(op.pairs(rows, same, other), rows)


@query("JN4 JN5 JN8", f"WITH {R1}, {PAIRS} SELECT a, b, shared, low FROM prs")
def overlap_pairs(spark, d):
    return op.pairs(regions(spark, d))


@query("JN3 JN13 X36 SET7 SET8", f"WITH {R1}, {PAIRS}, {TOT}, {SIM} SELECT a, b, shared, round(iou, 6) AS iou, round(in_a, 6) AS in_a, round(in_b, 6) AS in_b, round(jaccard, 6) AS jaccard, round(weighted_containment, 6) AS weighted_containment FROM sim")
def weighted_jaccard(spark, d):
    sim = _similar(spark, d)[1]
    return sim.withColumns({c: F.round(c, 6) for c in ("iou", "in_a", "in_b", "jaccard", "weighted_containment")})


CC = f"""e AS (SELECT a, b FROM sim WHERE round(jaccard, 9) >= {T} UNION SELECT b, a FROM sim WHERE round(jaccard, 9) >= {T})"""
REACH = """WITH RECURSIVE {ctes}, walk(node, root) AS (SELECT region, region FROM tot UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.node)"""


@query("GR1 GR5 SRC10", REACH.format(ctes=f"{R1}, {PAIRS}, {TOT}, {SIM}, {CC}") + " SELECT node AS region, min(root) AS cluster FROM walk GROUP BY 1")
def association_clusters(spark, d):
    rows, sim = _similar(spark, d)
    return op.clusters(rows, sim, T)


@query(
    "TOP12 AGG11",
    REACH.format(ctes=f"{R1}, {PAIRS}, {TOT}, {SIM}, {CC}")
    + """, cl AS (SELECT node AS region, min(root) AS cluster FROM walk GROUP BY 1)
SELECT cluster, count(DISTINCT region) AS members, count(DISTINCT view) AS views, count(DISTINCT entity) AS entities FROM cl JOIN regions USING (region) GROUP BY 1""",
)
def association_registry(spark, d):
    rows, sim = _similar(spark, d)
    return (
        op.clusters(rows, sim, T)
        .join(rows, "region")
        .groupBy("cluster")
        .agg(F.countDistinct("region").alias("members"), F.countDistinct("view").alias("views"), F.countDistinct("entity").alias("entities"))
    )


ALL = PAIRS.replace(" AND l.concept = r.concept AND l.view <> r.view", "")
KINDS = """kinds AS (SELECT CASE WHEN x.concept = y.concept AND in_a >= 0.27 AND in_b >= 0.27 THEN 'merge' WHEN x.concept <> y.concept AND in_a >= 0.27 AND in_b <= 0.26 THEN 'part_of'
    WHEN x.concept <> y.concept AND in_b >= 0.27 AND in_a <= 0.26 THEN 'part_of' ELSE 'noise' END AS kind,
  CASE WHEN x.concept = y.concept AND in_a >= 0.27 AND in_b >= 0.27 THEN CASE WHEN x.size < y.size THEN a ELSE b END WHEN x.concept <> y.concept AND in_a >= 0.27 AND in_b <= 0.26 THEN a
    WHEN x.concept <> y.concept AND in_b >= 0.27 AND in_a <= 0.26 THEN b ELSE a END AS source, a, b, shared
  FROM sim JOIN con x ON x.region = a JOIN con y ON y.region = b)"""
CON = "con AS (SELECT region, any_value(concept) AS concept, count(*) AS size FROM regions GROUP BY 1)"


def _classified(spark, d):
    rows, sim = _similar(spark, d, False, False)
    concepts = rows.groupBy("region").agg(F.first("concept").alias("concept"), F.count("*").alias("size"))
    return rows, concepts, op.classified(sim, concepts, 0.27, 0.27, 0.26)


@query("JN6 GR9 SET3", f"WITH {R1}, {ALL}, {TOT}, {SIM}, {CON}, {KINDS} SELECT kind, source, CASE WHEN source = a THEN b ELSE a END AS target, shared FROM kinds")
def overlap_classify(spark, d):
    return _classified(spark, d)[2]


@query(
    "GR10 GR7 CHK16 AGG9",
    f"""WITH {R1}, {ALL}, {TOT}, {SIM}, {CON}, {KINDS}, pt AS (SELECT vec_id AS entity, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
edges AS (SELECT source, CASE WHEN source = a THEN b ELSE a END AS target FROM kinds WHERE kind = 'part_of'),
g AS (SELECT region, count(*) AS size, sum(x * weight) / sum(weight) AS cx, min(y) AS min_y, max(z) AS max_z FROM regions JOIN pt USING (entity) GROUP BY 1)
SELECT region, size, round(cx, 6) AS cx, round(min_y, 6) AS min_y, round(max_z, 6) AS max_z, (SELECT count(*) FROM edges WHERE source = region) AS parents FROM g""",
)
def part_of_graph(spark, d):
    rows, _, kinds = _classified(spark, d)
    edges = kinds.where("kind = 'part_of'").groupBy(F.col("source").alias("region")).agg(F.count("*").alias("parents"))
    geometry = op.geometry(rows.select("region", "entity", "weight"), points(spark, d), "region")
    return geometry.join(edges, "region", "left").select(
        "region", "size", F.round("cx", 6).alias("cx"), F.round("min_y", 6).alias("min_y"), F.round("max_z", 6).alias("max_z"), F.coalesce("parents", F.lit(0)).alias("parents")
    )


@query("GR7 CHK16", "SELECT 0::BIGINT AS on_cycles, (SELECT count(*) FROM nation WHERE n_nationkey <> n_regionkey) AS edges")
def acyclic_check(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey > n_regionkey").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    small = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey <> n_regionkey").agg(F.count("*").alias("edges"))
    left = graph.cycles(nations).agg(F.count("*").alias("on_cycles"))
    return left.crossJoin(small)


@query(
    "GR8",
    "WITH RECURSIVE a AS (SELECT s_suppkey AS source, s_suppkey // 3 AS target FROM supplier WHERE s_suppkey > 2), w(source, target) AS (SELECT source, target FROM a UNION ALL SELECT w.source, a.target FROM w JOIN a ON a.source = w.target) SELECT source, min(target) AS target FROM w GROUP BY 1",
)
def alias_terminals(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey > 2")
    return graph.terminals(s.select(F.col("s_suppkey").alias("source"), F.expr("s_suppkey div 3").alias("target")))


@query(
    "JN12",
    f"""WITH {R1}, {TOT}, own AS (SELECT DISTINCT region, view, concept FROM regions), pr AS (SELECT x.region AS a, y.region AS b, x.view, x.concept FROM own x JOIN own y ON x.view = y.view AND x.concept = y.concept AND x.region < y.region),
sh AS (SELECT p.a, p.b, (SELECT count(*) FROM regions l JOIN regions r ON l.entity = r.entity WHERE l.region = p.a AND r.region = p.b) AS shared FROM pr p)
SELECT p.a, p.b, p.view, p.concept FROM pr p JOIN sh USING (a, b) JOIN tot x ON x.region = p.a JOIN tot y ON y.region = p.b WHERE shared / (x.size + y.size - shared) <= 0.15""",
)
def same_view_cannot_links(spark, d):
    return op.disjoint_in_view(regions(spark, d), 0.15)


@query(
    "JN14 JN15 MTH34",
    f"""WITH {R1}, {PAIRS}, {TOT}, {SIM} SELECT a, b, round(greatest(jaccard, 0.5 * weighted_containment) * (0.75 + 0.25 * 0.5), 6) AS score FROM sim WHERE shared >= 130 AND (iou >= 0.16 OR greatest(in_a, in_b) >= 0.3)""",
)
def candidate_edges(spark, d):
    sim = _similar(spark, d)[1]
    kept = sim.where((F.col("shared") >= 130) & ((F.col("iou") >= 0.16) | (F.greatest("in_a", "in_b") >= 0.3)))
    score = F.greatest(F.col("jaccard"), 0.5 * F.col("weighted_containment")) * (0.75 + 0.25 * 0.5)
    return kept.select("a", "b", F.round(score, 6).alias("score"))


@query(
    "TOP18 TOP17",
    f"""WITH {R1}, {PAIRS}, {TOT}, {SIM}, v AS (SELECT DISTINCT region, view FROM regions), j AS (SELECT a, b, x.view AS va, y.view AS vb, round(jaccard, 9) AS s FROM sim JOIN v x ON x.region = a JOIN v y ON y.region = b),
r AS (SELECT *, row_number() OVER (PARTITION BY a, vb ORDER BY s DESC, b) AS rb, row_number() OVER (PARTITION BY b, va ORDER BY s DESC, a) AS ra FROM j) SELECT a, b, round(s, 6) AS s FROM r WHERE ra = 1 AND rb = 1""",
)
def mutual_best_regions(spark, d):
    rows, sim = _similar(spark, d)
    return op.mutual_best(sim, rows.select("region", "view").distinct(), "jaccard").withColumn("s", F.round("s", 6))


@query(
    "TOP17",
    f"""WITH {R1}, {PAIRS}, {TOT}, {SIM}, r AS (SELECT a, b, jaccard, row_number() OVER o AS place, coalesce(lead(jaccard) OVER o, 0) AS second FROM sim WINDOW o AS (PARTITION BY a ORDER BY round(jaccard, 9) DESC, b))
SELECT a, b, round(second / jaccard, 6) AS ambiguity FROM r WHERE place = 1 AND second / jaccard <= 0.97""",
)
def unambiguous_matches(spark, d):
    order = Window.partitionBy("a").orderBy(F.round("jaccard", 9).desc(), "b")
    rows = _similar(spark, d)[1].withColumn("place", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("jaccard").over(order), F.lit(0.0)))
    ambiguity = F.col("second") / F.col("jaccard")
    return rows.where("place = 1").where(ambiguity <= 0.97).select("a", "b", F.round(ambiguity, 6).alias("ambiguity"))


@query(
    "JN17 JN18",
    f"""WITH {R1}, core AS (SELECT DISTINCT entity FROM regions WHERE region <= 3), {TOT}, n AS (SELECT count(*) AS n FROM core)
SELECT region, count(*) AS shared, round(count(*) / any_value(t.size), 6) AS containment, round(count(*) / any_value(n.n), 6) AS coverage FROM regions JOIN core USING (entity) JOIN tot t USING (region), n GROUP BY region""",
)
def regions_in_core(spark, d):
    rows = regions(spark, d)
    core = rows.where("region <= 3").select("entity").distinct()
    size = core.agg(F.count("*").alias("n"))
    return (
        rows.join(core, "entity", "left_semi")
        .groupBy("region")
        .agg(F.count("*").alias("shared"))
        .join(op.totals(rows).select("region", "size"), "region")
        .crossJoin(F.broadcast(size))
        .select("region", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("containment"), F.round(F.col("shared") / F.col("n"), 6).alias("coverage"))
    )


@query(
    "JN22 X17",
    f"""WITH {R1}, s AS (SELECT DISTINCT concept, entity FROM regions), n AS (SELECT concept, count(*) AS n FROM s GROUP BY 1)
SELECT x.concept AS a, y.concept AS b, count(*) AS shared, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS iou, count(*) / least(any_value(p.n), any_value(q.n)) >= 0.2 AS conflict
FROM s x JOIN s y ON x.entity = y.entity AND x.concept < y.concept JOIN n p ON p.concept = x.concept JOIN n q ON q.concept = y.concept GROUP BY 1, 2""",
)
def class_pair_overlap(spark, d):
    s = regions(spark, d).select("concept", "entity").distinct()
    n = s.groupBy("concept").agg(F.count("*").alias("n"))
    a, b = (s.withColumnRenamed("concept", c) for c in "ab")
    shared = a.join(b, "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = shared.join(n.select(F.col("concept").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("concept").alias("b"), F.col("n").alias("nb")), "b")
    return j.select(
        "a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("iou"), (F.col("shared") / F.least("na", "nb") >= 0.2).alias("conflict")
    )
