"""Point-cloud files, JSON and CSV configs, written and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..sources import configs, ply
from ..sources.encodings import table
from ..storage import scratch_path
from .registry import query

KINDS = {"x": "float", "y": "float", "z": "float", "label": "uchar"}


def _cloud(spark, d):
    e = table(spark, d, "embeddings").where("vec_id >= 0")
    return e.select(F.col("vec_id").alias("entity"), *(F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate("xyz")), F.col("label").cast("int").alias("label"))


def _written(spark, d):
    path = scratch_path(spark, "points.ply")
    ply.write_ply(_cloud(spark, d), path, KINDS, rows_per_part=200)
    return path


@query("SRC1 SRC2 SRC3 SRC4 SRC5 SNK3 SNK9", "SELECT vec_id AS entity, round(CAST(embedding[1] AS DOUBLE), 5) AS x, round(CAST(embedding[3] AS DOUBLE), 5) AS z, CAST(label AS INT) AS label FROM embeddings")
def ply_round_trip(spark, d):
    rows = ply.read_ply(spark, _written(spark, d), rows_per_partition=150)
    return rows.select("entity", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in "xz"), F.col("label").cast("int").alias("label"))


@query("SRC7 SRC5", "SELECT count(*) AS n, round(sum(round(CAST(embedding[1] AS DOUBLE), 5)), 4) AS x FROM embeddings")
def model_point_cloud(spark, d):
    """The point cloud of a model folder's iteration, located and read."""
    model = scratch_path(spark, "model")
    ply.write_ply(_cloud(spark, d), f"{model}/point_cloud/iteration_7000/point_cloud.ply", KINDS, rows_per_part=200)
    rows = ply.read_ply(spark, configs.model_file(spark, model, 7000))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("x").cast("double"), 5)), 4).alias("x"))


@query("SNK1 SNK2 SNK4 SNK10 SNK11 CHK4", "SELECT count(*) AS n, CAST(sum(CASE WHEN vec_id % 3 = 0 THEN 1 + label ELSE 0 END) AS BIGINT) AS total, 5 AS properties FROM embeddings")
def ply_label_property(spark, d):
    source, target = _written(spark, d), scratch_path(spark, "labelled.ply")
    values = table(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("entity"), (F.col("label") + 1).alias("value"))
    ply.append_property(spark, source, target, values, "semantic")
    rows = ply.read_ply(spark, target)
    return rows.agg(F.count("*").alias("n"), F.sum("semantic").cast("bigint").alias("total")).withColumn("properties", F.lit(len(rows.columns) - 1))


def _put(spark, name: str, text: str) -> str:
    path = scratch_path(spark, name)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()
    return path


WORDS = {
    "scene": "s",
    "phrases": [{"phrase": "house", "role": "thing", "synonyms": ["building"]}, {"phrase": "door", "role": "part", "synonyms": []}, {"phrase": "sky", "role": "stuff", "synonyms": ["clouds"]}],
    "expected_part_of": [["door", "house"]],
}


@query("SRC14 HSH2 SRC15 SRC20 SRC23", "SELECT * FROM (VALUES ('house', 'house', 'thing'), ('building', 'house', 'thing'), ('door', 'door', 'part'), ('sky', 'sky', 'stuff'), ('clouds', 'sky', 'stuff')) t(phrase, concept, role)")
def vocabulary_table(spark, d):
    return configs.vocabulary(spark, _put(spark, "words.json", json.dumps(WORDS, indent=1)))[0]


@query("SRC18", "SELECT * FROM (VALUES ('sofa', 'couch'), ('sofa', 'settee'), ('tv', 'television')) t(class, prompt)")
def alias_table(spark, d):
    return configs.aliases(spark, _put(spark, "aliases.json", json.dumps({"version": "1", "aliases": {"sofa": ["couch", "settee"], "tv": ["television"]}})))


@query("SRC16 PRJ7", "SELECT * FROM (VALUES (0, 1), (1, 0), (2, 2), (3, 1)) t(raw_id, class_id)")
def compact_ontology(spark, d):
    rows = spark.createDataFrame([(0, "wall", "stuff"), (1, "misc", "ignore"), (2, "chair", "thing"), (3, "wall", "stuff")], "index int, project string, type string")
    return configs.compact_ontology(rows)


@query("SRC6", "SELECT * FROM (VALUES (0, 'a.png', 2.0::DOUBLE), (1, 'b.png', 4.0)) t(id, img_name, aspect)")
def camera_table(spark, d):
    rows = [{"id": i, "img_name": f"{n}.png", "width": w, "height": 100, "position": [0, 0, i], "rotation": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "fx": 1.0, "fy": 1.0} for i, n, w in ((0, "a", 200), (1, "b", 400))]
    return configs.cameras(spark, _put(spark, "cameras.json", json.dumps(rows))).select("id", "img_name", (F.col("width") / F.col("height")).alias("aspect"))


@query("SRC27", "SELECT * FROM (VALUES (0, 0, 'keep'), (3, 1, 'merge')) t(source_id, final_id, status)")
def review_table(spark, d):
    text = "source_id,final_id,final_name,final_class,status,notes\n0,0,unlabeled,unlabeled,keep,\n3,1,wall,wall,merge,\n"
    return configs.review_sheet(spark, _put(spark, "review.csv", text)).select("source_id", "final_id", "status")


@query("HSH1 CHK8 X33", "SELECT sha256('abc') AS sha256, true AS same")
def file_digest(spark, d):
    import hashlib

    found = configs.file_digests(spark, _put(spark, "some.bin", "abc"))
    return found.select("sha256", (F.col("sha256") == hashlib.sha256(b"abc").hexdigest()).alias("same"))


@query("SNK5 SNK6 SRC13", "SELECT l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY 1")
def partitioned_sink(spark, d):
    path = scratch_path(spark, "membership")
    table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").write.partitionBy("l_returnflag").mode("errorifexists").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"))
