"""Integrity checks: every query counts what breaks a rule."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.encodings import table
from .registry import query


@query("CHK1 CHK2 JN7", "SELECT (SELECT count(*) FROM lineitem l ANTI JOIN part ON p_partkey = l_partkey) AS unknown_labels, (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM part WHERE p_partkey < 0) AS negative_ids")
def integrity_labels(spark, d):
    part = table(spark, d, "part")
    unknown = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("unknown_labels"))
    repeated = part.groupBy("p_partkey").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_ids"))
    return unknown.crossJoin(repeated).crossJoin(part.agg(F.count_if(F.col("p_partkey") < 0).alias("negative_ids")))


@query("CHK3 CHK4", "SELECT count(*) FILTER (p_name IS NULL OR trim(p_name) = '') AS unnamed, count(*) FILTER (p_type ILIKE '%object_candidate%') AS candidates, count(*) AS n FROM part")
def integrity_label_map(spark, d):
    return table(spark, d, "part").agg(
        F.count_if(F.col("p_name").isNull() | (F.trim("p_name") == "")).alias("unnamed"), F.count_if(F.col("p_type").ilike("%object_candidate%")).alias("candidates"), F.count("*").alias("n")
    )


@query("CHK7 CHK13 JN9 X32", "SELECT count(*) FILTER (l_orderkey IS NULL) AS without_items, count(*) FILTER (o_orderkey IS NULL) AS without_order, count(*) AS n FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def integrity_provenance(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey").distinct()
    j = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    return j.agg(F.count_if(F.col("l_orderkey").isNull()).alias("without_items"), F.count_if(F.col("o_orderkey").isNull()).alias("without_order"), F.count("*").alias("n"))


@query(
    "CHK9 CMP22",
    "WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) * (1 + CASE WHEN l_partkey % 10 = 0 THEN 0.01 ELSE 0.0001 END) AS v FROM lineitem WHERE l_partkey % 50 <> 7 GROUP BY 1)\nSELECT count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS unmatched, count(*) FILTER (abs(a.v - b.v) > 1e-6 + 2e-3 * abs(b.v)) AS apart FROM a FULL JOIN b ON a.k = b.k",
)
def integrity_pass_masses(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    b = items.where("k % 50 <> 7").select(F.col("k").alias("bk"), (F.col("v") * (1 + F.when(F.col("k") % 10 == 0, 0.01).otherwise(0.0001))).alias("bv"))
    j = items.join(b, F.col("k") == F.col("bk"), "full")
    return j.agg(
        F.count_if(F.col("k").isNull() | F.col("bk").isNull()).alias("unmatched"),
        F.count_if(F.abs(F.col("v") - F.col("bv")) > 1e-6 + 2e-3 * F.abs("bv")).alias("apart"),
    )


@query("CHK10 CHK15", "SELECT count(*) FILTER (l_discount < 0 OR l_discount > 1) AS out_of_range, count(*) FILTER (l_linenumber < 1 OR l_linenumber > 7) AS bad_index, count(*) FILTER (l_tax IS NULL OR isnan(l_tax)) AS not_finite FROM lineitem")
def integrity_ranges(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("out_of_range"),
        F.count_if((F.col("l_linenumber") < 1) | (F.col("l_linenumber") > 7)).alias("bad_index"),
        F.count_if(F.col("l_tax").isNull() | F.isnan("l_tax")).alias("not_finite"),
    )


CURVE = "c AS (SELECT l_suppkey AS observer, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), o AS (SELECT observer, n, row_number() OVER (ORDER BY n DESC, observer) AS step, sum(n) OVER (ORDER BY n DESC, observer) AS covered, sum(n) OVER () AS total FROM c)"


def _curve(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("observer")).agg(F.countDistinct("l_partkey").alias("n"))
    order = Window.orderBy(F.desc("n"), "observer")  # observers are a dimension
    return c.withColumn("step", F.row_number().over(order)).withColumn("covered", F.sum("n").over(order)).crossJoin(c.agg(F.sum("n").alias("total")))


@query("CHK12 TOP10", f"WITH {CURVE} SELECT min(step)::INT AS step, CAST(min(covered) AS BIGINT) AS covered FROM o WHERE covered >= ceil(0.6 * total)")
def coverage_prefix(spark, d):
    return _curve(spark, d).where(F.col("covered") >= F.ceil(0.6 * F.col("total"))).agg(F.min("step").alias("step"), F.min("covered").alias("covered"))


@query("CHK12 X31", f"WITH {CURVE}, m AS (SELECT covered - coalesce(lag(covered) OVER (ORDER BY step), 0) AS gain, n, lag(n) OVER (ORDER BY step) AS earlier FROM o) SELECT count(*) FILTER (gain <= 0) AS not_rising, count(*) FILTER (n > earlier) AS out_of_order FROM m")
def integrity_curve(spark, d):
    order = Window.orderBy("step")
    m = _curve(spark, d).withColumn("gain", F.col("covered") - F.coalesce(F.lag("covered").over(order), F.lit(0))).withColumn("earlier", F.lag("n").over(order))
    return m.agg(F.count_if(F.col("gain") <= 0).alias("not_rising"), F.count_if(F.col("n") > F.col("earlier")).alias("out_of_order"))


@query("CHK14 STR16", "SELECT p_type AS prompt, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def integrity_prompt_owners(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("prompt")).agg(F.countDistinct("p_brand").alias("owners")).where("owners > 1")


@query("CHK6", "WITH m AS (SELECT avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem), n AS (SELECT sum(l_discount) / count(*) AS a, sum(l_tax) / count(*) AS b FROM lineitem) SELECT abs(m.a - n.a) <= 1e-9 AND abs(m.b - n.b) <= 1e-9 AS equal, m.a >= m.b AS not_worse FROM m, n")
def gate_check(spark, d):
    items = table(spark, d, "lineitem")
    m = items.agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), (F.sum("l_discount") / F.count("*")).alias("c"), (F.sum("l_tax") / F.count("*")).alias("e"))
    return m.select(((F.abs(F.col("a") - F.col("c")) <= 1e-9) & (F.abs(F.col("b") - F.col("e")) <= 1e-9)).alias("equal"), (F.col("a") >= F.col("b")).alias("not_worse"))


@query("JN1 JN2 SRC22", "SELECT n_name AS name, coalesce(r.r_name, 'fallback_' || (n_nationkey % 3)) AS frame FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON r_regionkey = n_regionkey")
def lookup_with_fallback(spark, d):
    first = table(spark, d, "region").where("r_regionkey < 3")
    second = spark.createDataFrame([(0, "fallback_0"), (1, "fallback_1"), (2, "fallback_2")], "k int, other string")
    j = table(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(F.broadcast(second), F.pmod("n_nationkey", F.lit(3)) == F.col("k"), "left")
    return j.select(F.col("n_name").alias("name"), F.coalesce("r_name", "other").alias("frame"))


@query("JN10 TOP10 X40", "SELECT * FROM (VALUES (0, 12), (1, 3), (2, 7)) w(place, observer) JOIN (SELECT s_suppkey, s_name AS name FROM supplier) ON s_suppkey = observer".replace("SELECT *", "SELECT place, observer, name"))
def ordered_selection(spark, d):
    wanted = spark.createDataFrame([([12, 3, 7],)], "w array<int>").select(F.posexplode("w").alias("place", "observer"))
    return table(spark, d, "supplier").join(F.broadcast(wanted), F.col("s_suppkey") == F.col("observer")).select("place", "observer", F.col("s_name").alias("name"))


@query("JN7 X19", "SELECT count(*) AS n, count(*) FILTER (inside) AS inside FROM (SELECT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AS inside FROM part)")
def membership_flags(spark, d):
    some = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("inside", F.lit(True))
    j = table(spark, d, "part").join(some, "p_partkey", "left")
    return j.agg(F.count("*").alias("n"), F.count("inside").alias("inside"))


@query("TOP9 X28", "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT DISTINCT CAST(round_even(k * (n - 1) / 9.0, 0) AS BIGINT) AS position FROM n, range(10) r(k)")
def evenly_spaced(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    return spark.range(10).crossJoin(n).select(F.rint(F.col("id") * (F.col("n") - 1) / F.lit(9.0)).cast("bigint").alias("position")).distinct()


@query("SRC25 SRC26 X26", "SELECT c_nationkey AS site, c_mktsegment AS scene, count(*) AS files, max(c_custkey) AS best, n_name AS setting FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey GROUP BY ALL")
def trace_inventory(spark, d):
    even = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("scene")).agg(F.count("*").alias("files"), F.max("c_custkey").alias("best"))
    return rows.join(even, F.col("site") == F.col("n_nationkey"), "left").select("site", "scene", "files", "best", F.col("n_name").alias("setting"))


@query("X38 X39 X44", "SELECT l_shipdate::DATE - DATE '1992-01-01' AS frame, list_sort(list(DISTINCT l_returnflag)) AS classes FROM lineitem WHERE l_suppkey = 1 GROUP BY 1".replace("l_shipdate::DATE - DATE '1992-01-01' AS frame, list_sort(list(DISTINCT l_returnflag)) AS classes", "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS frame, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS classes, count(*) AS n"))
def frame_classes(spark, d):
    frame = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").where("l_suppkey = 1").groupBy(frame.alias("frame")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("classes"), F.count("*").alias("n"))
