import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.sources import configs, ply

KINDS = {"x": "float", "y": "double", "tag": "uchar", "big": "uint"}


def cloud(spark, n=50):
    return spark.range(n).select(
        F.col("id").alias("entity"), (F.col("id") / 4).cast("float").alias("x"), (F.col("id") / 3).alias("y"), (F.col("id") % 7).cast("int").alias("tag"), (F.col("id") + 3_000_000_000).alias("big")
    )


def test_round_trip_and_ranges(spark, tmp_path):
    path = str(tmp_path / "a.ply")
    ply.write_ply(cloud(spark), path, KINDS, rows_per_part=7)
    rows = ply.read_ply(spark, path, rows_per_partition=11)
    assert rows.rdd.getNumPartitions() == 5 and ply.vertex_count(path) == 50
    got = sorted(tuple(r) for r in rows.select("entity", "x", "y", "tag", "big").collect())
    assert got == sorted(tuple(r) for r in cloud(spark).collect())
    assert rows.select("tag").agg(F.sum("tag")).first()[0] == sum(i % 7 for i in range(50))


def test_big_endian_and_trailing_elements(spark, tmp_path):
    path = tmp_path / "b.ply"
    head = "ply\nformat binary_big_endian 1.0\ncomment x\nelement vertex 3\nproperty float x\nproperty short s\nelement face 1\nproperty list uchar int vertex_index\nend_header\n"
    body = np.array([(1.5, -2), (2.5, 3), (3.5, 4)], dtype=[("x", ">f4"), ("s", ">i2")]).tobytes()
    path.write_bytes(head.encode() + body + b"\x03" + b"\0" * 12)
    assert [tuple(r) for r in ply.read_ply(spark, str(path)).collect()] == [(0, 1.5, -2), (1, 2.5, 3), (2, 3.5, 4)]


@pytest.mark.parametrize("change", [("binary_little_endian", "ascii"), ("property float x", "property list uchar int x"), ("ply\n", "plx\n")])
def test_refused_files(spark, tmp_path, change):
    path = tmp_path / "c.ply"
    path.write_bytes("ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nend_header\n".replace(*change).encode())
    with pytest.raises(ValueError):
        ply.read_header(str(path))


def test_append_property(spark, tmp_path):
    a, b = str(tmp_path / "a.ply"), str(tmp_path / "b.ply")
    ply.write_ply(cloud(spark), a, KINDS)
    values = spark.createDataFrame([(3, 9), (5, 8)], "entity long, value int")
    ply.append_property(spark, a, b, values, "label")
    got = {r["entity"]: r["label"] for r in ply.read_ply(spark, b).collect()}
    assert got == {i: {3: 9, 5: 8}.get(i, 0) for i in range(50)}
    with pytest.raises(ValueError):
        ply.append_property(spark, b, str(tmp_path / "c.ply"), values, "label")
    with pytest.raises(FileExistsError):
        ply.write_ply(cloud(spark), a, KINDS)


def test_gaps_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        ply.write_ply(cloud(spark).where("entity <> 4"), str(tmp_path / "g.ply"), KINDS)


def test_output_choice():
    assert ply.choose_output("o/", None, "n.ply", False) == "o/n.ply"
    assert ply.choose_output("o", None, None, True) is None
    with pytest.raises(ValueError):
        ply.choose_output("o", "p", "n", False)


WORDS = {"scene": "s", "phrases": [{"phrase": "house", "role": "thing", "synonyms": ["home"]}, {"phrase": "door", "role": "part", "synonyms": []}], "expected_part_of": [["door", "house"]]}


def put(tmp_path, value):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_vocabulary(spark, tmp_path):
    rows, edges = configs.vocabulary(spark, put(tmp_path, WORDS))
    assert rows.count() == 3 and [tuple(r) for r in edges.collect()] == [("door", "house")]


@pytest.mark.parametrize("change", [{"phrases": WORDS["phrases"] + WORDS["phrases"][:1]}, {"phrases": [{"phrase": "a", "role": "odd", "synonyms": []}]}, {"expected_part_of": [["roof", "house"]]}])
def test_bad_vocabulary(spark, tmp_path, change):
    with pytest.raises(configs.BadConfig):
        configs.vocabulary(spark, put(tmp_path, WORDS | change))


def test_ontology_and_review(spark, tmp_path):
    good = {"version": "1", "classes": [{"ade_id": i, "ade_name": str(i), "project_id": i + 1, "project_class": "c", "type": "thing"} for i in range(3)]}
    assert configs.ontology(spark, put(tmp_path, good)).count() == 3
    good["classes"][1]["ade_id"] = 7
    with pytest.raises(configs.BadConfig):
        configs.ontology(spark, put(tmp_path, good))
    sheet = tmp_path / "r.csv"
    sheet.write_text("source_id,final_id,final_name,final_class,status,notes\n0,1,a,b,keep,\n")
    with pytest.raises(configs.BadConfig):
        configs.review_sheet(spark, str(sheet))


def test_canonical_digest():
    assert configs.canonical_digest({"b": 1, "a": [2, "é"]}) == configs.canonical_digest({"a": [2, "é"], "b": 1})


def test_missing_and_malformed_configs(spark, tmp_path):
    model = tmp_path / "model"
    for read in (configs.cameras, lambda s, p: configs.model_file(s, p, 30)):
        with pytest.raises(FileNotFoundError):
            read(spark, str(model))
    (model / "point_cloud" / "iteration_30").mkdir(parents=True)
    (model / "point_cloud" / "iteration_30" / "point_cloud.ply").write_text("ply")
    assert configs.model_file(spark, f"{model}/", 30) == f"{model}/point_cloud/iteration_30/point_cloud.ply"
    with pytest.raises(FileNotFoundError):
        configs.model_file(spark, str(model), 31)
    camera = {"id": 3, "img_name": "a", "width": 4, "height": 2, "position": [0, 0, 1], "rotation": [[1, 0, 0]] * 3, "fx": 1.0, "fy": 1.0}
    (model / "cameras.json").write_text(json.dumps([camera]))
    assert configs.cameras(spark, str(model)).first()["id"] == 3
    (model / "cameras.json").write_text(json.dumps([camera | {"width": "wide"}]))
    with pytest.raises(Exception, match="MALFORMED|Malformed|parse"):
        configs.cameras(spark, str(model)).collect()
    (tmp_path / "broken.json").write_text('{"phrases": [')
    with pytest.raises(Exception, match="MALFORMED|Malformed|parse"):
        configs.vocabulary(spark, str(tmp_path / "broken.json"))


def test_storage_wants_a_shared_folder_on_a_cluster(monkeypatch):
    from tallyframe import storage

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session)


def test_prompted_masks_refuse_other_shapes(spark):
    import numpy as np

    from tallyframe.sources import scoring

    views = spark.createDataFrame([(1, 2, 3, [0.0] * 6)], "view long, height int, width int, pixels array<double>")
    with pytest.raises(Exception, match="mask of shape"):
        scoring.segmented(views, [("a", "a")], lambda: lambda image, phrase: [(1.0, np.ones((3, 2), bool))], 0.5).collect()
    assert scoring.segmented(views, [("a", "a")], lambda: lambda image, phrase: [(1.0, image > 0)], 0.5).count() == 0
    assert scoring.starts(8, 4, 3) == [0, 3, 4] and scoring.starts(3, 4, 2) == [0]
