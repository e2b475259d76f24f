"""Vectors and class distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats as op
from ..sources.encodings import table
from .registry import query

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)"
SOFT = "x AS (SELECT vec_id, label, list_transform(v, lambda a: exp(5 * a)) AS u FROM e), soft AS (SELECT vec_id, label, list_transform(u, lambda a: a / list_sum(u)) AS p FROM x)"


def _soft(spark, d):
    scaled = F.transform("embedding", lambda v: v.cast("double") * 5)
    return table(spark, d, "embeddings").select("vec_id", "label", op.softmax(scaled).alias("p"))


@query("MTH7 MTH4", f"WITH {E} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.vec_id % 50 = 0")
def cosine_pairs(spark, d):
    """Queries are the vectors whose id is divisible by 50, against all of their label."""
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("u")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("v"))
    return a.join(b, "label").where("a <> b").select("a", "b", F.round(op.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("TOP3 MTH5", f"WITH {E}, s AS (SELECT a.vec_id, b.label AS class, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON b.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, class ORDER BY round(c, 9) DESC) AS place FROM s)\nSELECT vec_id, class, round(avg(c), 6) AS mean, round(max(c), 6) AS best, round(avg(c) FILTER (place <= 2), 6) AS top2 FROM r GROUP BY ALL")
def prompt_aggregation(spark, d):
    e = table(spark, d, "embeddings")
    prompts = e.where("vec_id % 50 = 0").select(F.col("label").alias("class"), F.col("embedding").alias("q"))
    s = e.select("vec_id", "embedding").join(prompts).select("vec_id", "class", op.cosine(F.col("embedding"), F.col("q")).alias("c"))
    r = s.withColumn("place", F.row_number().over(Window.partitionBy("vec_id", "class").orderBy(F.round("c", 9).desc())))
    return r.groupBy("vec_id", "class").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.max("c"), 6).alias("best"), F.round(F.avg(F.when(F.col("place") <= 2, F.col("c"))), 6).alias("top2"))


@query("MTH2 MTH3 WIN11", f"WITH {E}, {SOFT} SELECT vec_id, round(list_max(p), 6) AS top, round(list_reverse_sort(p)[2], 6) AS second, round((list_max(p) - list_reverse_sort(p)[2]) / list_max(p), 6) AS margin, round(1 - list_sum(list_transform(p, lambda q: -q * ln(q))) / ln(64), 6) AS confidence FROM soft")
def entropy_confidence(spark, d):
    ranked = F.sort_array("p", asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return _soft(spark, d).select(
        "vec_id", F.round(top, 6).alias("top"), F.round(second, 6).alias("second"), F.round((top - second) / top, 6).alias("margin"), F.round(op.entropy_confidence(F.col("p")), 6).alias("confidence")
    )


@query("TOP6 WIN14", f"WITH {E}, {SOFT}, w AS (SELECT vec_id, label, list_position(p, list_max(p)) AS owner, list_max(p) AS score FROM soft), k AS (SELECT owner, count(*) AS area FROM w WHERE score >= 0.03 GROUP BY 1 HAVING count(*) >= 2) SELECT CAST(row_number() OVER (ORDER BY area DESC, owner) AS INT) AS id, CAST(owner AS BIGINT) AS owner, area FROM k")
def query_regions(spark, d):
    w = _soft(spark, d).select(F.array_position("p", F.array_max("p")).alias("owner"), F.array_max("p").alias("score"))
    k = w.where("score >= 0.03").groupBy("owner").agg(F.count("*").alias("area")).where("area >= 2")
    return k.select(F.row_number().over(Window.orderBy(F.desc("area"), "owner")).alias("id"), "owner", "area")


@query("AGG44 X5", f"WITH {E}, m AS (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(a * a)) AS n FROM m GROUP BY 1) SELECT label, CAST(i - 1 AS INT) AS dim, round(a / n, 5) AS value FROM m JOIN n USING (label)")
def normalised_means(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    m = x.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("a"))
    return m.select("label", "dim", F.round(F.col("a") / F.sqrt(F.sum(F.col("a") * F.col("a")).over(Window.partitionBy("label"))), 5).alias("value"))


ROBUST = "md AS (SELECT label, i, exp(quantile_cont(ln(p[i]), 0.5)) AS a FROM soft, range(1, 65) t(i) GROUP BY ALL), rob AS (SELECT label, i, a / sum(a) OVER (PARTITION BY label) AS p FROM md)"


def _robust(rows, keys):
    x = rows.select(*keys, F.posexplode("p").alias("class_id", "q"))
    m = x.groupBy(*keys, "class_id").agg(F.exp(F.percentile(F.ln("q"), 0.5)).alias("a"))
    return m.withColumn("p", F.col("a") / F.sum("a").over(Window.partitionBy(*keys)))


@query("AGG32", f"WITH {E}, {SOFT}, {ROBUST} SELECT label, CAST(i - 1 AS INT) AS class_id, round(p, 5) AS p FROM rob")
def robust_distribution(spark, d):
    return _robust(_soft(spark, d), ["label"]).select("label", "class_id", F.round("p", 5).alias("p"))


STABLE = """h AS (SELECT label, held, i, quantile_cont(ln(p[i]), 0.5) AS a FROM soft s JOIN (SELECT DISTINCT label, vec_id AS held FROM soft) USING (label), range(1, 65) t(i) WHERE s.vec_id <> held GROUP BY ALL),
hw AS (SELECT label, held, i AS w FROM h QUALIFY row_number() OVER (PARTITION BY label, held ORDER BY round(a, 9) DESC, i) = 1), fw AS (SELECT label, i AS w FROM rob QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(p, 9) DESC, i) = 1)"""


@query("AGG33 CMP20 CMP21 GR23 GR24", f"WITH {E}, {SOFT}, {ROBUST}, {STABLE} SELECT f.label, CAST(f.w - 1 AS INT) AS winner, count(h.held) AS held_out, count(h.held) FILTER (h.w = f.w) AS agreeing, CASE WHEN count(h.held) = count(h.held) FILTER (h.w = f.w) THEN 'unanimous' WHEN count(h.held) - count(h.held) FILTER (h.w = f.w) = 1 THEN 'one_outlier' ELSE 'unstable' END AS tier FROM fw f LEFT JOIN hw h USING (label) GROUP BY f.label, f.w")
def stability_tiers(spark, d):
    """Every member is held out in turn; the median of the others follows from three values in the middle of each class."""
    soft = _soft(spark, d)
    best = lambda rows, keys: rows.groupBy(*keys).agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("class_id")).alias("c"))).alias("b")).select(*keys, (-F.col("b.c")).alias("w"))
    full = best(_robust(soft, ["label"]), ["label"]).withColumnRenamed("w", "winner")
    logs = soft.select("vec_id", "label", F.transform("p", lambda q: F.ln(q)).alias("logs"))
    middle = logs.select("label", F.posexplode("logs").alias("class_id", "a")).groupBy("label", "class_id").agg(F.sort_array(F.collect_list("a")).alias("s"))
    half, one = F.floor((F.size("s") - 1) / 2).cast("int"), F.size("s") == 1
    at = [F.get("s", half + k) for k in range(-1, 3)]
    middle = middle.select("label", "class_id", F.size("s").alias("n"), F.when(~one, F.struct(*(x.alias(f"m{k}") for k, x in enumerate(at)))).alias("m"))
    middle = middle.groupBy("label").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("class_id", "m"))), lambda x: x.m).alias("middle"))

    def others(a, m):
        # Of n values the middle ones are m1 (and m2 if n is even); without a value up to them the next one moves in.
        even = F.when(a <= m.m1, m.m2).otherwise(m.m1)
        odd = F.when(a < m.m1, (m.m1 + m.m2) / 2).when(a > m.m1, (m.m0 + m.m1) / 2).otherwise((m.m0 + m.m2) / 2)
        return F.round(F.when(F.pmod(F.col("n"), F.lit(2)) == 0, even).otherwise(odd), 9)

    medians = logs.join(middle, "label").where("n > 1").select("label", F.col("vec_id").alias("held"), F.zip_with("logs", "middle", others).alias("medians"))
    held = medians.select("label", "held", (F.array_position("medians", F.array_max("medians")) - 1).cast("int").alias("w"))
    g = full.join(held, "label", "left").groupBy("label", "winner").agg(F.count("held").alias("held_out"), F.count_if(F.col("w") == F.col("winner")).alias("agreeing"))
    missing = F.col("held_out") - F.col("agreeing")
    return g.withColumn("tier", F.when(missing == 0, "unanimous").when(missing == 1, "one_outlier").otherwise("unstable"))


@query("X7", f"WITH {E}, {SOFT}, {ROBUST}, {STABLE}, t AS (SELECT f.label, count(h.held) - count(h.held) FILTER (h.w = f.w) AS missing FROM fw f LEFT JOIN hw h USING (label) GROUP BY 1) SELECT CASE WHEN missing = 0 THEN 'unanimous' WHEN missing = 1 THEN 'one_outlier' ELSE 'unstable' END AS tier, count(*) AS n FROM t GROUP BY 1")
def tier_counts(spark, d):
    return stability_tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"))
