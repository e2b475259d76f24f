"""Profiles, calibration, coverage, grids and boxes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as op
from ..sources.encodings import matched, stored_means, stored_sums, table
from ..storage import materialize
from .registry import query


def _quantiles(x, digits=4):
    return ", ".join(f"round(quantile_cont({x}, {p}), {digits}) AS p{int(p * 100):02d}" for p in op.QUANTILES)


@query("AGG17 AGG18", f"SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, {_quantiles('CAST(n_chars AS DOUBLE)', 1)} FROM documents GROUP BY 1")
def quantile_profile(spark, d):
    out = op.profile(table(spark, d, "documents"), "n_chars", ["lang"])
    return out.withColumns({f"p{int(p * 100):02d}": F.round(f"p{int(p * 100):02d}", 1) for p in op.QUANTILES})


COVER = "f AS (SELECT l_suppkey AS frame, l_linenumber >= 2 AS inner_px, greatest(abs(l_discount - l_tax), abs(l_tax - 0.04)) > 0.035 AS changed FROM lineitem)"


@query("AGG22 AGG23 AGG42", f"WITH {COVER}, g AS (SELECT frame, count(*) FILTER (changed) AS hit, count(*) AS n FROM f WHERE inner_px GROUP BY ROLLUP (frame)) SELECT coalesce(frame, -1) AS frame, hit, n, round(hit / n, 6) AS coverage FROM g")
def coverage_rollup(spark, d):
    changed = F.greatest(F.abs(F.col("l_discount") - F.col("l_tax")), F.abs(F.col("l_tax") - 0.04)) > 0.035
    g = table(spark, d, "lineitem").where("l_linenumber >= 2").rollup(F.col("l_suppkey").alias("frame")).agg(F.count_if(changed).alias("hit"), F.count("*").alias("n"))
    return g.select(F.coalesce("frame", F.lit(-1)).alias("frame"), "hit", "n", F.round(F.col("hit") / F.col("n"), 6).alias("coverage"))


@query("AGG23", f"WITH {COVER}, g AS (SELECT frame, count(*) FILTER (changed) / count(*) AS c FROM f WHERE inner_px GROUP BY 1) SELECT round(min(c), 6) AS low, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.9), 6) AS p90, round(max(c), 6) AS high FROM g")
def coverage_spread(spark, d):
    changed = F.greatest(F.abs(F.col("l_discount") - F.col("l_tax")), F.abs(F.col("l_tax") - 0.04)) > 0.035
    g = table(spark, d, "lineitem").where("l_linenumber >= 2").groupBy("l_suppkey").agg((F.count_if(changed) / F.count("*")).alias("c"))
    q = g.agg(F.min("c").alias("a"), F.percentile("c", [0.1, 0.5, 0.9]).alias("q"), F.max("c").alias("b"))
    at = lambda i: F.round(F.get("q", F.lit(i)), 6)
    return q.select(F.round("a", 6).alias("low"), at(0).alias("p10"), at(1).alias("p50"), at(2).alias("p90"), F.round("b", 6).alias("high"))


HIST = "h AS (SELECT CAST(least(floor(least(greatest(value / 500, 0.0), 1.0) * 20), 19) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(20)) AS INT) AS bin) b LEFT JOIN h ON h.bin = b.bin), cdf AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM c)"


def _cdf(spark, d):
    return op.cumulative(table(spark, d, "events").withColumn("x", F.col("value") / 500), "x", 20)


@query("AGG37 AGG38", f"WITH {HIST} SELECT bin, n, round(cdf, 6) AS cdf FROM cdf")
def calibration_cdf(spark, d):
    return _cdf(spark, d).withColumn("cdf", F.round("cdf", 6))


@query("MTH37 AGG39", f"WITH {HIST} SELECT target, min(bin) AS bin FROM cdf, (VALUES (1.0::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE), (0.1::DOUBLE)) t(target) WHERE round(cdf, 9) >= round(1 - target, 9) GROUP BY 1")
def profile_minimum_bins(spark, d):
    return op.profile_bins(_cdf(spark, d), (1.0, 0.5, 0.25, 0.1))


@query(
    "MTH38",
    """WITH v AS (SELECT l_suppkey AS k, avg(l_discount) * 10 AS a, avg(l_tax) * 12 AS b FROM lineitem GROUP BY 1), x AS (SELECT k, CAST(least(floor(least(greatest(a, 0), 1) * 50), 49) AS INT) AS ba, CAST(least(floor(least(greatest(b, 0), 1) * 50), 49) AS INT) AS bb FROM v)
SELECT k, round(least((SELECT count(*) FROM x y WHERE y.ba <= x.ba), (SELECT count(*) FROM x y WHERE y.bb <= x.bb)) / (SELECT count(*) FROM x), 6) AS weakest FROM x""",
)
def weakest_rank(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_discount", "l_tax", "_metadata")
    # Means that may be on either side of a bin's bound.
    close = lambda factor: lambda m: F.abs(m * factor * 50 - F.rint(m * factor * 50)) < 1e-9
    a, b = (stored_means(rows, ["k"], c, close(f)).select("k", (F.col("mean") * f).alias(n)) for n, c, f in (("a", "l_discount", 10), ("b", "l_tax", 12)))
    v = materialize(a.alias("l").join(b.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k"))).select("l.k", "a", "b"), "ranked")
    x = v.select("k", op.bin_of(F.col("a"), 50).alias("ba"), op.bin_of(F.col("b"), 50).alias("bb"))
    for c, n in (("a", "ba"), ("b", "bb")):
        cdf = op.cumulative(v, c, 50).select(F.col("bin").alias(n), F.col("cdf").alias(f"r{c}"))
        x = x.join(F.broadcast(cdf), n)
    return x.select("k", F.round(F.least("ra", "rb"), 6).alias("weakest"))


@query("AGG26 AGG33 CMP16 FLT5", "WITH g AS (SELECT p_brand AS class, sum(p_size) AS total, max(p_size) AS views, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1) SELECT class, CAST(total AS BIGINT) AS total, views, kinds, concat_ws(',', CASE WHEN total < 2000 THEN 'small' END, CASE WHEN kinds < 3 THEN 'uniform' END) AS reasons FROM g")
def class_records(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("class")).agg(F.sum("p_size").alias("total"), F.max("p_size").alias("views"), F.countDistinct("p_type").alias("kinds"))
    reasons = F.array_compact(F.array(F.when(F.col("total") < 2000, "small"), F.when(F.col("kinds") < 3, "uniform")))
    return g.withColumn("reasons", F.array_join(reasons, ","))


@query("AGG24 AGG21", "SELECT * FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 20")
def top_counters(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return n.withColumn("place", F.row_number().over(order)).where("place <= 20").drop("place")


@query("AGG41 CMP18", "WITH g AS (SELECT user_id AS region, event_type AS class, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT *, v / sum(v) OVER (PARTITION BY region) AS share, row_number() OVER (PARTITION BY region ORDER BY v DESC, class) AS place, lead(v) OVER (PARTITION BY region ORDER BY v DESC, class) AS second, count(*) OVER (PARTITION BY region) AS n FROM g)\nSELECT region, class, round(share, 6) AS share, CASE WHEN n < 2 THEN 'too_few' WHEN share < 0.25 THEN 'low_share' WHEN v - second < 50 THEN 'low_margin' ELSE 'accepted' END AS decision FROM s WHERE place = 1")
def region_identity(spark, d):
    by, order = Window.partitionBy("region"), Window.partitionBy("region").orderBy(F.desc("v"), F.asc_nulls_last("class"))
    # A total of zero divides as doubles do.
    over_zero = F.when(F.col("v") > 0, math.inf).when(F.col("v") < 0, -math.inf).when(F.col("v") == 0, math.nan)
    first = lambda g: (
        g.withColumn("total", F.sum("v").over(by))
        .withColumn("share", F.when(F.col("total") == 0, over_zero).otherwise(F.try_divide("v", "total")))
        .withColumn("n", F.count("*").over(by))
        .withColumn("place", F.row_number().over(order))
        .withColumn("second", F.lead("v").over(order))
        .where("place = 1")
    )
    rows = table(spark, d, "events").select(F.col("user_id").alias("region"), F.col("event_type").alias("class"), "value", "_metadata")
    g = materialize(rows.groupBy("region", "class").agg(F.sum("value").alias("v")), "sums")
    # Regions whose first class, margin, share or rounded share may be on either side of its bound.
    margin, share = F.col("v") - F.col("second"), F.col("share")
    at = (margin < 1e-6) | (F.abs(margin - 50) < 1e-6) | (F.abs(share - 0.25) < 1e-9) | (F.abs(F.pmod(share * 1e6, F.lit(1.0)) - 0.5) < 1e-6)
    exact = stored_sums(rows, ["region", "class"], "value", first(g).where(at).select("region")).drop("n")
    s = first(matched(g, exact, ["region", "class"], "left").select("region", "class", F.coalesce("exact", "v").alias("v")))
    decision = F.when(F.col("n") < 2, "too_few").when(share < 0.25, "low_share").when(margin < 50, "low_margin").otherwise("accepted")
    return s.select("region", "class", F.round("share", 6).alias("share"), decision.alias("decision"))


GRID = "grid AS (SELECT o_orderkey // 120 AS py, o_orderkey % 120 AS px, CAST(o_custkey % 3 AS INT) AS class_id FROM orders)"


@query("MTH28 CHK11", f"WITH {GRID} SELECT py, px, coalesce(class_id <> lag(class_id) OVER r, false) OR coalesce(class_id <> lead(class_id) OVER r, false) OR coalesce(class_id <> lag(class_id) OVER c, false) OR coalesce(class_id <> lead(class_id) OVER c, false) AS boundary FROM grid WINDOW r AS (PARTITION BY py ORDER BY px), c AS (PARTITION BY px ORDER BY py)")
def class_boundaries(spark, d):
    g = table(spark, d, "orders").select(F.expr("o_orderkey div 120").alias("py"), F.pmod("o_orderkey", F.lit(120)).alias("px"), F.pmod("o_custkey", F.lit(3)).alias("class_id"))
    edge = F.lit(False)
    for w in (Window.partitionBy("py").orderBy("px"), Window.partitionBy("px").orderBy("py")):
        for near in (F.lag("class_id").over(w), F.lead("class_id").over(w)):
            edge = edge | F.coalesce(F.col("class_id") != near, F.lit(False))
    return g.select("py", "px", edge.alias("boundary"))


@query("MTH25 X15 SRC21 SNK7", "WITH m AS (SELECT o_custkey AS region, o_orderkey % 120 AS px, o_orderkey // 120 AS py FROM orders) SELECT region, min(px) AS x, min(py) AS y, max(px) - min(px) AS w, max(py) - min(py) AS h, count(*) AS area FROM m GROUP BY 1")
def region_boxes(spark, d):
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("region"), F.pmod("o_orderkey", F.lit(120)).alias("px"), F.expr("o_orderkey div 120").alias("py"))
    return m.groupBy("region").agg(F.min("px").alias("x"), F.min("py").alias("y"), (F.max("px") - F.min("px")).alias("w"), (F.max("py") - F.min("py")).alias("h"), F.count("*").alias("area"))


BOXES = "b AS (SELECT s_suppkey AS k, (s_suppkey % 17) / 20.0 AS cx, (s_suppkey % 13) / 15.0 AS cy, 0.1 + (s_suppkey % 5) / 20.0 AS w, 0.1 + (s_suppkey % 7) / 20.0 AS h FROM supplier), c AS (SELECT k, least(greatest((cx - w / 2) * 640, 0), 640)::DOUBLE AS x0, least(greatest((cy - h / 2) * 480, 0), 480)::DOUBLE AS y0, least(greatest((cx + w / 2) * 640, 0), 640)::DOUBLE AS x1, least(greatest((cy + h / 2) * 480, 0), 480)::DOUBLE AS y1 FROM b)"


def _boxes(spark, d):
    k = F.col("s_suppkey")
    part = lambda m, n: F.pmod(k, F.lit(m)).cast("double") / n
    box = op.corners(part(17, 20.0), part(13, 15.0), 0.1 + part(5, 20.0), 0.1 + part(7, 20.0), 640, 480)
    return table(spark, d, "supplier").select(k.alias("k"), *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


@query("MTH27", f"WITH {BOXES} SELECT k, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM c")
def pixel_boxes(spark, d):
    return _boxes(spark, d).withColumns({n: F.round(n, 6) for n in ("x0", "y0", "x1", "y1")})


@query(
    "MTH24 MTH26 SET7",
    f"""WITH {BOXES}, i AS (SELECT p.k AS a, q.k AS b, greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, (q.x1 - q.x0) * (q.y1 - q.y0) AS qa,
  greatest(0, least(floor(p.x1), floor(q.x1)) - greatest(floor(p.x0), floor(q.x0)) + 1) * greatest(0, least(floor(p.y1), floor(q.y1)) - greatest(floor(p.y0), floor(q.y0)) + 1) AS px FROM c p JOIN c q ON p.k < q.k AND p.k // 20 = q.k // 20)
SELECT a, b, round(coalesce(i / nullif(pa + qa - i, 0), 0), 6) AS iou, CAST(px AS BIGINT) AS pixels FROM i""",
)
def box_overlaps(spark, d):
    c = _boxes(spark, d)
    names = ("x0", "y0", "x1", "y1")
    # A frame holds twenty boxes.
    frame = F.floor(F.col("k") / 20).alias("frame")
    p = c.select(frame, F.col("k").alias("a"), *(F.col(n).alias(f"p{n}") for n in names))
    q = c.select(frame, F.col("k").alias("b"), *(F.col(n).alias(f"q{n}") for n in names))
    pb, qb = [F.col(f"p{n}") for n in names], [F.col(f"q{n}") for n in names]
    px = op.pixel_intersection([F.floor(x) for x in pb], [F.floor(x) for x in qb])
    return p.join(q, "frame").where("a < b").select("a", "b", F.round(op.box_iou(pb, qb), 6).alias("iou"), px.cast("bigint").alias("pixels"))


@query("MTH29 MTH30", "SELECT p_partkey AS k, CAST(floor((p_size * 13 + 7) * 512 / least(p_size * 13 + 7, p_size * 9 + 20) + 0.5) AS BIGINT) AS sw, CAST(floor((p_size * 9 + 20) * 512 / least(p_size * 13 + 7, p_size * 9 + 20) + 0.5) AS BIGINT) AS sh, CAST(greatest(1, round_even((p_size * 13 + 7) * least(1.0::DOUBLE, 320.0::DOUBLE / (p_size * 13 + 7)), 0)) AS BIGINT) AS w, CAST(greatest(1, round_even((p_size * 9 + 20) * least(1.0::DOUBLE, 320.0::DOUBLE / (p_size * 13 + 7)), 0)) AS BIGINT) AS h FROM part")
def resized_dimensions(spark, d):
    w, h = F.col("p_size") * 13 + 7, F.col("p_size") * 9 + 20
    (sw, sh), (a, b) = op.resized(w, h, 512), op.scaled(w, h, 320)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), sw.alias("sw"), sh.alias("sh"), a.alias("w"), b.alias("h"))


@query("MTH6", "WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS v FROM supplier) SELECT k, round(CASE WHEN max(v) OVER w - min(v) OVER w < 1e-12 THEN 1 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6)::DOUBLE AS scaled FROM s WINDOW w AS (PARTITION BY g)")
def min_max_scaled(spark, d):
    w = Window.partitionBy("s_nationkey")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round(op.min_max(F.col("s_acctbal"), w), 6).alias("scaled"))


@query("MTH33 MTH34 FLT7 JN19 JN20 MTH35 WIN23 X14", "WITH m AS (SELECT l_suppkey AS mask, l_linenumber AS region, count(*) AS shared, avg(l_discount) AS conf FROM lineitem GROUP BY ALL), a AS (SELECT l_suppkey AS mask, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT l_linenumber AS region, count(*) AS nb FROM lineitem GROUP BY 1),\ns AS (SELECT mask, region, 0.5 * shared / (na + nb - shared) + 0.3 * shared / na + 0.2 * conf AS score, shared / na AS inside FROM m JOIN a USING (mask) JOIN b USING (region)), r AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY round(score, 9) DESC, region) AS place, lead(score) OVER (PARTITION BY mask ORDER BY round(score, 9) DESC, region) AS second FROM s)\nSELECT mask, region, round(score, 6) AS score, CASE WHEN inside < 0.2 THEN 'rejected' WHEN score - second < 0.001 THEN 'ambiguous' ELSE 'owned' END AS status FROM r WHERE place = 1")
def region_matches(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mask"), F.col("l_linenumber").alias("region"), "l_discount")
    m = items.groupBy("mask", "region").agg(F.count("*").alias("shared"), F.avg("l_discount").alias("conf"))
    a, b = items.groupBy("mask").agg(F.count("*").alias("na")), items.groupBy("region").agg(F.count("*").alias("nb"))
    shared = F.col("shared")
    score = 0.5 * shared / (F.col("na") + F.col("nb") - shared) + 0.3 * shared / F.col("na") + 0.2 * F.col("conf")
    s = m.join(a, "mask").join(b, "region").withColumn("score", score)
    order = Window.partitionBy("mask").orderBy(F.round("score", 9).desc(), "region")
    r = s.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("place = 1")
    status = F.when(shared / F.col("na") < 0.2, "rejected").when(F.col("score") - F.col("second") < 0.001, "ambiguous").otherwise("owned")
    return r.select("mask", "region", F.round("score", 6).alias("score"), status.alias("status"))


@query("MTH36", "WITH c AS (SELECT l_partkey AS entity, sum(l_quantity) FILTER (l_returnflag = 'R') AS a, sum(l_quantity) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), n AS (SELECT entity, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM c) SELECT entity, CASE WHEN a / sqrt(a * a + b * b) + 0.2 > b / sqrt(a * a + b * b) THEN 1 ELSE 0 END AS label FROM n")
def slack_labels(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)).alias("b"),
    )
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return sums.select("entity", F.when(F.col("a") / norm + 0.2 > F.col("b") / norm, 1).otherwise(0).alias("label"))
