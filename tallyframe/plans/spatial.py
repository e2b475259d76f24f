"""Voxels, radius graphs, neighbours, projections and poses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import labels as lb
from ..operators import spatial as op
from ..sources.encodings import C1, P1, cameras, points
from ..storage import materialize
from .registry import query

SIZE = 0.1
VOX = f"vox AS (SELECT *, CAST(floor(x / {SIZE}) AS BIGINT) AS vx, CAST(floor(y / {SIZE}) AS BIGINT) AS vy, CAST(floor(z / {SIZE}) AS BIGINT) AS vz FROM {{t}})"
CELLS = "cells AS (SELECT {by} vx, vy, vz, min(entity) AS node FROM vox GROUP BY ALL)"
WALK = """edges AS (SELECT a.node AS u, b.node AS v FROM cells a JOIN cells b ON abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 {on}),
walk(node, root) AS (SELECT node, node FROM cells UNION SELECT e.v, w.root FROM walk w JOIN edges e ON e.u = w.node),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY 1)"""


def chain(t="points", by="", on=""):
    return f"{P1}, {VOX.format(t=t)}, {CELLS.format(by=by)}, {WALK.format(on=on)}, members AS (SELECT v.*, component FROM vox v JOIN cells c USING ({by} vx, vy, vz) JOIN comp USING (node))"


#: Points spread out so that some clusters stay apart.
SPARSE = "sparse AS (SELECT entity, label, x * 3 AS x, y * 3 AS y, z * 3 AS z FROM points)"


def _sparse(spark, d):
    return points(spark, d).withColumns({c: F.col(c) * 3 for c in "xyz"})


def sparse_chain(by="", on=""):
    base = chain("sparse", by, on)
    return base.replace(P1, f"{P1}, {SPARSE}")


@query("GR2 GR15", f"WITH RECURSIVE {sparse_chain()} SELECT entity, component FROM members")
def voxel_components(spark, d):
    return op.voxel_components(_sparse(spark, d), SIZE).select("entity", "component")


@query("GR15 GR14", f"WITH RECURSIVE {sparse_chain('label,', 'AND a.label = b.label')} SELECT label, component, count(*) AS size FROM members GROUP BY ALL HAVING count(*) >= 2")
def class_components(spark, d):
    return op.component_sizes(op.voxel_components(_sparse(spark, d), SIZE, ["label"]), ["label"]).where("size >= 2")


@query("GR4 GR13 GR17", f"WITH RECURSIVE {sparse_chain()}, s AS (SELECT component, count(*) AS size FROM members GROUP BY 1) SELECT entity, component FROM members JOIN s USING (component) WHERE size >= greatest(3, ceil(0.05 * (SELECT max(size) FROM s)))")
def component_prune(spark, d):
    return op.kept_components(op.voxel_components(_sparse(spark, d), SIZE), 3, 0.05).select("entity", "component")


@query("GR16 SRC11", f"WITH RECURSIVE {sparse_chain()} SELECT component, count(*) AS size, count(*) FILTER (entity % 7 = 0) AS anchors FROM members GROUP BY 1 HAVING count(*) FILTER (entity % 7 = 0) > 0 AND count(*) FILTER (entity % 7 = 0) / count(*) >= 0.2")
def seeded_components(spark, d):
    p = _sparse(spark, d)
    return op.seeded(op.voxel_components(p, SIZE), p.where("entity % 7 = 0"), 0.2)


GUARD = f"WITH RECURSIVE {sparse_chain()}, g AS (SELECT component, count(*) AS size, count(*) FILTER (entity % 5 = 0 AND label = 3) AS matching, count(*) FILTER (entity % 5 = 0 AND label > 0 AND label <> 3) AS conflicting FROM members GROUP BY 1)"


@query("GR19 GR18", f"{GUARD} SELECT *, matching > 0 AND conflicting = 0 AS accepted FROM g")
def seed_guard(spark, d):
    p = _sparse(spark, d)
    return op.seed_guard(op.voxel_components(p, SIZE), p.where("entity % 5 = 0").select("entity", F.col("label").alias("seed")), 3)


@query(
    "GR12",
    f"""WITH RECURSIVE {sparse_chain()}, big AS (SELECT component FROM members GROUP BY 1 HAVING count(*) >= 2), lnk AS (SELECT DISTINCT m.component, m.label FROM members m JOIN big USING (component)),
pr AS (SELECT DISTINCT a.label AS u, b.label AS v FROM lnk a JOIN lnk b USING (component)), lw(label, root) AS (SELECT label, label FROM (SELECT DISTINCT label FROM points) UNION SELECT p.v, l.root FROM lw l JOIN pr p ON p.u = l.label)
SELECT label, min(root) AS root FROM lw GROUP BY 1""",
)
def consolidated_labels(spark, d):
    from ..operators.graph import components

    members = op.voxel_components(_sparse(spark, d), SIZE)
    big = op.component_sizes(members).where("size >= 2")
    # Labels hang on the components they touch; negative ids keep the two kinds of nodes apart.
    edges = members.join(big, "component").select((-F.col("label") - 1).cast("bigint").alias("u"), F.col("component").alias("v")).distinct()
    least = Window.partitionBy("root")
    roots = components(edges).where("node < 0").select((-F.col("node") - 1).cast("int").alias("label"), "root")
    named = roots.withColumn("first", F.min("label").over(least)).select("label", F.col("first").alias("root"))
    return members.select("label").distinct().join(named, "label", "left").select("label", F.coalesce("root", "label").alias("root"))


@query(
    "GR20 GR21 X1 X3",
    f"""WITH RECURSIVE {sparse_chain()}, cores AS (SELECT component, count(*) AS size, count(DISTINCT entity % 9) AS observers FROM members GROUP BY 1) SELECT component, size, observers FROM cores WHERE size >= 2 AND observers >= 2""",
)
def spatial_cores(spark, d):
    members = op.voxel_components(_sparse(spark, d), SIZE)
    return members.groupBy("component").agg(F.count("*").alias("size"), F.countDistinct(F.pmod("entity", F.lit(9))).alias("observers")).where("size >= 2 and observers >= 2")


NEAR = "near AS (SELECT a.entity, b.entity AS other, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS distance FROM {a} a JOIN {b} b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {r} * {r})"


@query("GR3", f"WITH RECURSIVE {P1}, {NEAR.format(a='points', b='points', r=0.05)}, walk(node, root) AS (SELECT entity, entity FROM points UNION SELECT n.other, w.root FROM walk w JOIN near n ON n.entity = w.node) SELECT node AS entity, min(root) AS component FROM walk GROUP BY 1")
def radius_components(spark, d):
    return op.radius_components(points(spark, d), 0.05)


KNN = f"WITH {P1}, anchors AS (SELECT * FROM points WHERE entity % 2 = 0), q AS (SELECT * FROM points WHERE entity % 2 = 1), {NEAR.format(a='q', b='anchors', r=0.12)}, knn AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(distance, 9), other) AS place FROM near QUALIFY place <= 4)"


def _knn(spark, d):
    p = points(spark, d)
    return op.nearest(p.where("entity % 2 = 1"), p.where("entity % 2 = 0"), 4, 0.12)


@query("JN16 TOP20", f"{KNN} SELECT entity, other, round(distance, 6) AS distance, CAST(place AS INT) AS place FROM knn")
def knn_within_radius(spark, d):
    return _knn(spark, d).withColumn("distance", F.round("distance", 6))


@query(
    "GR22",
    f"""{KNN}, j AS (SELECT k.entity, k.distance, b.label = a.label AS same FROM knn k JOIN points a ON a.entity = k.entity JOIN points b ON b.entity = k.other),
g AS (SELECT entity, count(*) AS neighbours, count(*) FILTER (same) AS same, min(distance) FILTER (same) AS ns, min(distance) FILTER (NOT same) AS no FROM j GROUP BY 1)
SELECT entity, neighbours, same, same >= 1 AND same / neighbours >= 0.25 AND ns IS NOT NULL AND (no IS NULL OR ns <= no * 1.5) AS accepted FROM g""",
)
def knn_guard(spark, d):
    return op.consistent_neighbours(_knn(spark, d), points(spark, d), F.col("label"), 1, 0.25, 1.5).select("entity", "neighbours", "same", "accepted")


@query("MTH31", f"WITH {P1}, {NEAR.format(a='points', b='points', r=0.2)}, k AS (SELECT entity, distance FROM near WHERE entity <> other QUALIFY row_number() OVER (PARTITION BY entity ORDER BY round(distance, 9), other) = 3) SELECT count(*) AS n, round(quantile_cont(distance, 0.5), 6) AS spacing FROM k")
def local_spacing(spark, d):
    third = op.neighbour_distance(points(spark, d), 3, 0.2)
    return third.agg(F.count("*").alias("n"), F.round(F.percentile("distance", 0.5), 6).alias("spacing"))


@query("MTH9 MTH10", f"WITH {P1} SELECT label, round(greatest(0.05, least(0.6, quantile_cont(exp(greatest(-20, least(5, z))), 0.5) * 0.3)), 6) AS size FROM points GROUP BY 1")
def adaptive_voxels(spark, d):
    return op.voxel_size(points(spark, d), "z", 0.3, 0.05, 0.6, "label").withColumn("size", F.round("size", 6))


@query("SRC24 TOP9", f"WITH {P1}, n AS (SELECT count(*) AS n FROM points), i AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / 19.0, 0) AS BIGINT) AS entity FROM n, (SELECT unnest(range(20)) AS k)) SELECT entity, round(x, 6) AS x FROM points JOIN i USING (entity)")
def evenly_sampled_points(spark, d):
    p = points(spark, d)
    n = p.agg(F.count("*").alias("n"))
    wanted = spark.range(20).crossJoin(n).select(F.rint(F.col("id") * (F.col("n") - 1) / F.lit(19.0)).cast("bigint").alias("entity")).distinct()
    return p.join(F.broadcast(wanted), "entity").select("entity", F.round("x", 6).alias("x"))


@query("MTH16 MTH19", None)
def principal_extents(spark, d):
    return op.robust_extents(points(spark, d), "label").select("label", "n", *(F.round(c, 6).alias(c) for c in ("e1", "e2", "e3")))


@query("MTH17 MTH20", None)
def matching_shapes(spark, d):
    e = op.robust_extents(points(spark, d), "label")
    a, b = (e.select(F.col("label").alias(f"{n}_label"), *(F.col(f"e{k}").alias(f"{n}{k}") for k in (1, 2, 3))) for n in "ab")
    match = op.shapes_match([F.col(f"a{k}") for k in (1, 2, 3)], [F.col(f"b{k}") for k in (1, 2, 3)], 1.3, 1.2)
    return a.join(b, F.col("a_label") < F.col("b_label")).select("a_label", "b_label", match.alias("match"))


@query(
    "MTH18 MTH22",
    f"""WITH {P1}, b AS (SELECT label, quantile_cont(x, 0.1) AS x0, quantile_cont(x, 0.9) AS x1, quantile_cont(y, 0.1) AS y0, quantile_cont(y, 0.9) AS y1 FROM points GROUP BY 1)
SELECT label, count(*) FILTER (x BETWEEN x0 - 0.1 * (x1 - x0) AND x1 + 0.1 * (x1 - x0) AND y BETWEEN y0 - 0.1 * (y1 - y0) AND y1 + 0.1 * (y1 - y0)) AS inside, count(*) AS n FROM points JOIN b USING (label) GROUP BY 1""",
)
def envelope_membership(spark, d):
    p = points(spark, d)
    q = [F.percentile(c, [0.1, 0.9]).alias(f"q{c}") for c in "xy"]
    j = p.join(p.groupBy("label").agg(*q), "label")
    low, high = (lambda c: F.get(f"q{c}", F.lit(0))), (lambda c: F.get(f"q{c}", F.lit(1)))
    inside = F.lit(True)
    for c in "xy":
        margin = 0.1 * (high(c) - low(c))
        inside = inside & (F.col(c) >= low(c) - margin) & (F.col(c) <= high(c) + margin)
    return j.groupBy("label").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))


PAIR = "p AS (SELECT a.observer AS a, b.observer AS b, a.px, a.py, a.pz, a.yaw, b.px AS qx, b.py AS qy, b.pz AS qz, b.yaw AS qyaw FROM cameras a JOIN cameras b ON b.observer - a.observer BETWEEN 1 AND 5)"


def _pairs(spark, d):
    """Every camera with the five that follow it, as in a recorded path."""
    c = cameras(spark, d)
    q = c.select(F.col("observer").alias("b"), *(F.col(f"p{x}").alias(f"q{x}") for x in "xyz"), F.col("yaw").alias("qyaw"))
    following = F.explode(F.sequence(F.col("observer") + 1, F.col("observer") + 5))
    return c.withColumn("b", following).withColumnRenamed("observer", "a").join(q, "b")


@query("MTH11", f"WITH {C1}, {PAIR} SELECT a, b, round(sqrt(((px-qx)*(px-qx) + (py-qy)*(py-qy) + (pz-qz)*(pz-qz)) / 100.0 + power(abs(((yaw - qyaw + {math.pi}) - floor((yaw - qyaw + {math.pi}) / {2 * math.pi}) * {2 * math.pi}) - {math.pi}) / {math.pi}, 2)), 5) AS distance FROM p")
def pose_distances(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(op.pose_distance(10.0, 1.0), 5).alias("distance"))


@query("MTH23", f"WITH {C1}, {PAIR} SELECT a, b, round(degrees(acos(greatest(-1, least(1, (px*qx + py*qy + pz*qz) / nullif(sqrt(px*px + py*py + pz*pz) * sqrt(qx*qx + qy*qy + qz*qz), 0))))), 4) AS angle FROM p")
def ray_angles(spark, d):
    angle = op.angle_between([F.col(f"p{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"])
    return _pairs(spark, d).select("a", "b", F.round(angle, 4).alias("angle"))


@query("MTH12", f"WITH {C1}, c AS (SELECT quantile_cont(px, 0.5) AS x, quantile_cont(py, 0.5) AS y, quantile_cont(pz, 0.5) AS z FROM cameras) SELECT round(quantile_cont(sqrt((px-x)*(px-x) + (py-y)*(py-y) + (pz-z)*(pz-z)), 0.5), 6) AS scale FROM cameras, c")
def position_scale(spark, d):
    c = cameras(spark, d)
    centre = c.agg(*(F.percentile(f"p{x}", 0.5).alias(x) for x in "xyz"))
    r = F.sqrt(sum((F.col(f"p{x}") - F.col(x)) * (F.col(f"p{x}") - F.col(x)) for x in "xyz"))
    return c.crossJoin(F.broadcast(centre)).where(r > 0).agg(F.round(F.percentile(r, 0.5), 6).alias("scale"))


PROJ = """pr AS (SELECT observer, entity, cos(yaw) * (z - pz) + sin(yaw) * (x - px) AS depth, cos(yaw) * (x - px) - sin(yaw) * (z - pz) AS side, y - py AS dy FROM cameras, points),
uv AS (SELECT observer, entity, depth, CASE WHEN depth > 1e-6 THEN 320 + 200 * side / depth END AS u, CASE WHEN depth > 1e-6 THEN 240 + 200 * dy / depth END AS v FROM pr)"""


METRIC = f"WITH {C1}, {P1}, {PROJ}, m AS (SELECT observer, avg(CAST(depth > 1e-6 AS DOUBLE)) AS front, avg(CAST(coalesce(u >= 0 AND u < 640 AND v >= 0 AND v < 480, false) AS DOUBLE)) AS inside, quantile_cont(depth, 0.01) AS z01 FROM uv GROUP BY 1)"


def _metrics(spark, d):
    return op.view_statistics(points(spark, d), cameras(spark, d), 200.0, 640.0, 480.0, 0.01).select("observer", "front", "inside", F.col("depth").alias("z01"))


@query("MTH13 MTH21 X27 X45 MTH15", f"{METRIC} SELECT observer, round(front, 6) AS front, round(inside, 6) AS inside, round(z01, 4) AS z01 FROM m")
def projection_metrics(spark, d):
    return _metrics(spark, d).select("observer", F.round("front", 6).alias("front"), F.round("inside", 6).alias("inside"), F.round("z01", 4).alias("z01"))


@query(
    "MTH14 FLT5 X29",
    f"""{METRIC}, b AS (SELECT min(front) - 0.05 AS front0, min(z01) - 1 AS z0 FROM m WHERE observer % 3 = 0)
SELECT observer, concat_ws(',', CASE WHEN front < front0 THEN 'front' END, CASE WHEN z01 < z0 THEN 'z_q01' END) AS reasons FROM m, b""",
)
def projection_rejections(spark, d):
    m = materialize(_metrics(spark, d), "views")
    bounds = m.where("observer % 3 = 0").agg((F.min("front") - 0.05).alias("front0"), (F.min("z01") - 1).alias("z0"))
    reasons = F.array_compact(F.array(F.when(F.col("front") < F.col("front0"), "front"), F.when(F.col("z01") < F.col("z0"), "z_q01")))
    return m.crossJoin(F.broadcast(bounds)).select("observer", F.array_join(reasons, ",").alias("reasons"))


@query(
    "X16 MTH22",
    f"""WITH {C1}, {P1}, {PROJ}, s AS (SELECT observer, entity, u, v, coalesce(u >= 0 AND u < 640 AND v >= 0 AND v < 480, false) AS inside FROM uv),
g AS (SELECT observer, avg(CAST(inside AS DOUBLE)) AS fraction, quantile_cont(u, 0.05) FILTER (inside) AS u0, quantile_cont(u, 0.95) FILTER (inside) AS u1 FROM s GROUP BY 1)
SELECT observer, round(fraction, 6) AS fraction, round(u0, 3) AS u0, round(u1, 3) AS u1 FROM g WHERE fraction >= 0.02 ORDER BY g.fraction DESC, observer LIMIT 6""",
)
def view_prompts(spark, d):
    p, c = points(spark, d), cameras(spark, d)
    g = op.view_statistics(p, c, 200.0, 640.0, 480.0).select("observer", F.col("inside").alias("fraction"))
    top = materialize(g.where("fraction >= 0.02").orderBy(F.desc("fraction"), "observer").limit(6), "top")
    # Only the six views that are returned need their boxes.
    u, _, _, inside = op.projected(200.0, 640.0, 480.0)
    seen = p.crossJoin(F.broadcast(c.join(F.broadcast(top), "observer"))).where(inside)
    g = seen.groupBy("observer", "fraction").agg(F.percentile(u, [0.05, 0.95]).alias("q"))
    return g.orderBy(F.desc("fraction"), "observer").select("observer", F.round("fraction", 6).alias("fraction"), F.round(F.get("q", F.lit(0)), 3).alias("u0"), F.round(F.get("q", F.lit(1)), 3).alias("u1"))


@query("MTH8 X34", "SELECT s_suppkey AS grp, CAST(CASE WHEN s_nationkey % 2 = 0 OR s_nationkey / 25.0 >= 0.6 THEN ceil((CASE WHEN s_nationkey % 2 = 0 THEN 50 ELSE 100 END) * greatest(0.5, 1 - s_nationkey / 25.0 / 2)) ELSE 100 END AS BIGINT) AS minimum FROM supplier")
def adaptive_minimum(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    thing = F.pmod("s_nationkey", F.lit(2)) == 0
    return s.select(F.col("s_suppkey").alias("grp"), lb.adaptive_minimum(F.col("s_nationkey"), 25, 10, thing, 50, 100, 0.6, 0.5).alias("minimum"))
