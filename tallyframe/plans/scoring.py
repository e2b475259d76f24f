"""The model seam: batch scores, crops, planes and admitted detections; the models themselves are out of scope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import scoring as op
from ..sources.encodings import stored_means, table
from .registry import query


def _linear():
    weights = np.arange(1, 65) / 64

    def score(batch):
        x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float) if batch.num_rows else np.empty((0, 64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(x @ weights, 5))], ["vec_id", "score"])

    return score


@query("", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i / 64)), 5) AS score FROM embeddings")
def batch_scores(spark, d):
    return op.scored(table(spark, d, "embeddings").select("vec_id", "embedding"), _linear, "vec_id bigint, score double")


@query("B7", "SELECT l_orderkey AS pixel, round(avg(l_discount), 6) AS value, count(*) AS crops FROM lineitem GROUP BY 1")
def crop_average(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pixel"), F.col("l_discount").alias("value"))
    return op.crop_average(rows, ["pixel"], "value").withColumn("value", F.round("value", 6))


@query("B13", "SELECT l_suppkey AS pixel, bit_or(CASE WHEN on_value >= 0.5 THEN 1 << plane ELSE 0 END) AS class_id, round(min(abs(on_value - 0.5)), 6) AS margin FROM (SELECT l_suppkey, l_linenumber AS plane, avg(l_tax) * 12.5 AS on_value FROM lineitem GROUP BY ALL) GROUP BY 1")
def decoded_planes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_linenumber").alias("plane"), "l_tax", "_metadata")
    # Means that may be on either side of the threshold, or halfway between two rounded margins.
    margin = lambda m: F.abs(m * 12.5 - 0.5)
    close = lambda m: (margin(m) < 1e-9) | (F.abs(F.pmod(margin(m) * 1e6, F.lit(1.0)) - 0.5) < 1e-6)
    means = stored_means(rows, ["pixel", "plane"], "l_tax", close)
    planes = means.select("pixel", "plane", (F.col("mean") * 12.5).alias("on"))
    return op.decoded_planes(planes, ["pixel"]).withColumn("margin", F.round("margin", 6))


def _images(spark, d):
    """Embeddings as images of eight by eight pixels."""
    pixels = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("view"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


PHRASES = [("bright", "light"), ("sunny", "light"), ("dark", "shade"), ("absent", "nothing")]


def _backend():
    """Stands for a promptable segmenter: masks by brightness, scored by the share of the image that they leave."""

    def segment(image, phrase):
        mask = {"bright": image > 0.1, "sunny": image > 0.2, "dark": image < -0.1}.get(phrase, image > 1e9)
        return [(1 - mask.mean(), mask)]

    return segment


@query(
    "B12",
    """WITH e AS (SELECT vec_id AS view, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), p(phrase, concept, n) AS (SELECT 'bright', 'light', 0 UNION ALL SELECT 'sunny', 'light', 1 UNION ALL SELECT 'dark', 'shade', 2),
m AS (SELECT view, phrase, concept, CAST(CASE phrase WHEN 'bright' THEN len(list_filter(v, lambda x: x > 0.1)) WHEN 'sunny' THEN len(list_filter(v, lambda x: x > 0.2)) ELSE len(list_filter(v, lambda x: x < -0.1)) END AS INT) AS pixels, n FROM e, p)
SELECT view, CAST(row_number() OVER (PARTITION BY view ORDER BY n) - 1 AS INT) AS place, phrase, concept, round(1 - pixels / 64, 6) AS score, pixels FROM m WHERE pixels > 0 AND 1 - pixels / 64 >= 0.75""",
)
def prompted_masks(spark, d):
    found = op.segmented(_images(spark, d), PHRASES, _backend, 0.75)
    return found.select("view", "place", "phrase", "concept", F.round("score", 6).alias("score"), "pixels")


def _scorer():
    """Stands for a dense classifier: a pixel against its crop's mean, and the mean."""
    return lambda crop: np.stack([crop - crop.mean(), np.full(crop.shape, crop.mean())], axis=2)


@query(
    "B4 B16",
    """WITH e AS (SELECT vec_id AS view, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), c(cy, cx) AS (SELECT a, b FROM (VALUES (0), (3), (4)) s(a), (VALUES (0), (3), (4)) t(b)),
m AS (SELECT view, cy, cx, avg(v) AS mean FROM e, c WHERE y BETWEEN cy AND cy + 3 AND x BETWEEN cx AND cx + 3 GROUP BY ALL)
SELECT view, y, x, round(avg(v - mean) + 1e-12::DOUBLE, 6) AS contrast, round(avg(mean) + 1e-12::DOUBLE, 6) AS level FROM e JOIN m USING (view) WHERE y BETWEEN cy AND cy + 3 AND x BETWEEN cx AND cx + 3 GROUP BY ALL""",
)
def overlapping_crops(spark, d):
    out = op.tiled(_images(spark, d), _scorer, 4, 3)
    value = lambda k: F.round(F.get("values", F.lit(k)) + 1e-12, 6)
    return out.select("view", "y", "x", value(0).alias("contrast"), value(1).alias("level"))


@query("B12", "SELECT event_id, value FROM events WHERE value >= 100 AND user_id > 0")
def admitted_detections(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.col("value").alias("score"), F.col("user_id").alias("area"))
    return op.admitted(rows, 100.0).select("event_id", "value")
