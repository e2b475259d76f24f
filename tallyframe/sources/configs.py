"""JSON and CSV inputs as tables, with the checks their readers make."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAMERA = "id int, img_name string, width int, height int, position array<double>, rotation array<array<double>>, fx double, fy double"
VOCABULARY = "scene string, phrases array<struct<phrase:string,role:string,synonyms:array<string>>>, expected_part_of array<array<string>>"
ONTOLOGY = "version string, classes array<struct<ade_id:int,ade_name:string,project_id:int,project_class:string,type:string>>"
ALIASES = "version string, aliases map<string,array<string>>"
REVIEW = "source_id int, final_id int, final_name string, final_class string, status string, notes string"


class BadConfig(ValueError):
    """A config that breaks its rules."""


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _refuse(rows: DataFrame, what: str) -> None:
    if found := rows.limit(5).collect():
        raise BadConfig(f"{what}: {[tuple(r) for r in found]}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def model_file(spark: SparkSession, model: str, iteration: int) -> str:
    """Path of a model's point cloud after ``iteration`` steps, in any store that Spark reads."""
    path = f"{model.rstrip('/')}/point_cloud/iteration_{iteration}/point_cloud.ply"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return path


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a model folder or of a file."""
    path = path if path.endswith(".json") else f"{path.rstrip('/')}/cameras.json"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return _json(spark, path, CAMERA)


def vocabulary(spark: SparkSession, path: str, roles: tuple[str, ...] = ("thing", "stuff", "part")) -> tuple[DataFrame, DataFrame]:
    """(phrase, concept, role) and (child, parent); every phrase once, known roles, edges between known concepts."""
    raw = _json(spark, path, VOCABULARY)
    head = raw.select(F.explode("phrases").alias("p"))
    rows = head.select(F.explode(F.concat(F.array("p.phrase"), F.coalesce("p.synonyms", F.array().cast("array<string>")))).alias("phrase"), F.col("p.phrase").alias("concept"), "p.role")
    edges = raw.select(F.explode("expected_part_of").alias("e")).select(F.get("e", F.lit(0)).alias("child"), F.get("e", F.lit(1)).alias("parent"))
    _refuse(rows.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1"), "phrases that occur twice")
    _refuse(rows.where(~F.col("role").isin(*roles)).select("phrase", "role"), "unknown roles")
    concepts = rows.select("concept").distinct()
    for side in ("child", "parent"):
        _refuse(edges.join(concepts, F.col(side) == F.col("concept"), "left_anti"), f"edges with an unknown {side}")
    return rows, edges


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """Classes with contiguous ids from 0 (raw) and 1 (project)."""
    rows = _json(spark, path, ONTOLOGY).select(F.explode("classes").alias("c")).select("c.*")
    _refuse(rows.agg(F.min("ade_id").alias("a"), F.max("ade_id").alias("b"), F.countDistinct("ade_id").alias("u"), F.count("*").alias("n")).where("a <> 0 or b <> n - 1 or u <> n"), "raw ids aren't contiguous")
    return rows


def compact_ontology(rows: DataFrame) -> DataFrame:
    """(raw_id, class_id) of a many-to-one map: kept classes numbered by first appearance, ignored ones 0."""
    first = rows.where("type <> 'ignore'").groupBy("project").agg(F.min("index").alias("at"))
    ids = first.select("project", F.row_number().over(Window.orderBy("at")).alias("class_id"))
    return rows.join(ids, "project", "left").select(F.col("index").alias("raw_id"), F.when(F.col("type") == "ignore", 0).otherwise(F.col("class_id")).alias("class_id"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, ALIASES).select(F.explode("aliases").alias("class", "prompts")).select("class", F.explode("prompts").alias("prompt"))


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed labels from CSV; whole numbers, no source twice, 0 stays 0."""
    rows = spark.read.schema(REVIEW).option("header", True).option("mode", "FAILFAST").csv(path)
    _refuse(rows.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1"), "sources that occur twice")
    _refuse(rows.where("source_id = 0 and final_id <> 0").select("source_id", "final_id"), "label 0 may not change")
    return rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, each read by a task."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def canonical_digest(value) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
