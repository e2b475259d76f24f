"""The driver's tables as evidence tables: observers vote with mass for classes of entities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: Groups of a bound that are sent to every task, so that the table isn't shuffled to find their rows.
BROADCAST_GROUPS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_sums(rows: DataFrame, keys: list[str], value: str, close: DataFrame) -> DataFrame:
    """(keys, n, exact) of the groups that match ``close`` on its columns: sums of doubles, added in the order in which the rows are stored.

    A sum of doubles depends on its order in the last digits, and so does a decision on a sum or mean that lies on a bound.
    SQL adds the rows as they are stored if one thread runs it. Only groups that lie on a bound should be put in order,
    since all their rows go to one task; ``rows`` come straight from files and hold ``_metadata``.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"), *place)
    close = materialize(close, "close")
    few = F.broadcast(close) if close.count() <= BROADCAST_GROUPS else close
    ordered = matched(rows, few, close.columns, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_file", "_row", "_value"))).alias("_rows"))
    return ordered.select(*keys, F.size("_rows").alias("n"), F.aggregate("_rows", F.lit(0.0), lambda s, r: s + r["_value"]).alias("exact"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; the left's columns, and the right's others after them."""
    same = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    others = [] if how == "left_semi" else [f"r.{c}" for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *others)


def stored_means(rows: DataFrame, keys: list[str], value: str, near: Callable[[Column], Column]) -> DataFrame:
    """(keys, mean): means of doubles; those that are ``near`` a bound have their rows added in the order in which they are stored."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    exact = stored_sums(rows, keys, value, means.where(near(F.col("mean"))).select(*keys))
    exact = exact.select(*keys, (F.col("exact") / F.col("n")).alias("exact"))
    return matched(means, exact, keys, "left").select(*keys, F.coalesce("exact", "mean").alias("mean"))


def class_ids(df: DataFrame, column: str) -> DataFrame:
    """(column, class_id): ids from 1 in the order of the names; a small dimension."""
    names = df.select(column).distinct()
    return names.select(column, F.row_number().over(Window.orderBy(column)).alias("class_id"))


def event_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events of a type are an observer's mass for a class of a user."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("observer"), F.col("user_id").alias("entity"), "event_type"
    ).agg(F.count("*").cast("double").alias("mass"))
    return counts.join(class_ids(events, "event_type"), "event_type").select("observer", "entity", "class_id", "mass")


def order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's quantities by return flag and line status are its mass for a class of a part."""
    items = table(spark, sf_dir, "lineitem")
    flags = items.groupBy(
        F.col("l_suppkey").alias("observer"), F.col("l_partkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("flag")
    ).agg(F.sum("l_quantity").alias("mass"))
    return flags.join(class_ids(flags, "flag"), "flag").select("observer", "entity", "class_id", "mass")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as regions, in the views of their nations, over the parts they ship; concept by account.

    (region, view, concept, entity, weight)
    """
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("entity")).agg(
        F.sum("l_quantity").alias("weight")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("region"), F.col("s_nationkey").alias("view"), F.pmod(F.col("s_suppkey"), F.lit(4)).cast("int").alias("concept")
    )
    return items.join(suppliers, "region").select("region", "view", "concept", "entity", "weight")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, label, x, y, z): the first three dimensions of each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity"),
        "label",
        *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(observer, px, py, pz, yaw): poses from the numbers of suppliers."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("observer"),
        (F.col("s_acctbal") / 1000).alias("px"),
        F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double").alias("py"),
        F.col("s_nationkey").cast("double").alias("pz"),
        (F.pmod(F.col("s_suppkey") * 29, F.lit(360)).cast("double") * F.lit(3.141592653589793 / 180)).alias("yaw"),
    )


# The same tables in DuckDB SQL, to be used as common table expressions.
V1 = """classes AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS INT) AS class_id FROM (SELECT DISTINCT event_type FROM events)),
votes AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS observer, user_id AS entity, class_id, CAST(count(*) AS DOUBLE) AS mass
  FROM events JOIN classes USING (event_type) GROUP BY 1, 2, 3)"""
V2 = """flags AS (SELECT l_suppkey AS observer, l_partkey AS entity, l_returnflag || l_linestatus AS flag, sum(l_quantity) AS mass FROM lineitem GROUP BY 1, 2, 3),
classes AS (SELECT flag, CAST(row_number() OVER (ORDER BY flag) AS INT) AS class_id FROM (SELECT DISTINCT flag FROM flags)),
votes AS (SELECT observer, entity, class_id, mass FROM flags JOIN classes USING (flag))"""
R1 = """regions AS (SELECT i.region, s.s_nationkey AS view, CAST(i.region % 4 AS INT) AS concept, i.entity, i.weight
  FROM (SELECT l_suppkey AS region, l_partkey AS entity, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2) i JOIN supplier s ON s.s_suppkey = i.region)"""
P1 = """points AS (SELECT vec_id AS entity, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""
C1 = """cameras AS (SELECT s_suppkey AS observer, s_acctbal / 1000 AS px, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS py, CAST(s_nationkey AS DOUBLE) AS pz,
  CAST((s_suppkey * 29) % 360 AS DOUBLE) * (3.141592653589793 / 180) AS yaw FROM supplier)"""
