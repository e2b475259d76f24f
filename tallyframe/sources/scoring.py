"""The seam for models: rows go to a scorer in Arrow batches, one scorer for each task.

No model comes with the engine. ``make_scorer`` runs once in a task and returns a
function from a record batch to a record batch of ``schema``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, make_scorer: Callable, schema: str) -> DataFrame:
    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or make_scorer()
            yield scorer(batch)

    return rows.mapInArrow(run, schema)


def crop_average(crops: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of overlapping crops' values at each place."""
    return crops.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("crops"))


def decoded_planes(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Class ids from binary planes (plane, on): plane k holds bit k; ``margin`` is the least confident plane's."""
    bit = F.when(F.col("on") >= 0.5, F.expr("shiftleft(1, plane)")).otherwise(F.lit(0))
    return planes.groupBy(*keys).agg(F.bit_or(bit).alias("class_id"), F.min(F.abs(F.col("on") - 0.5)).alias("margin"))


def admitted(detections: DataFrame, min_score: float) -> DataFrame:
    """Detections that score enough and aren't empty."""
    return detections.where((F.col("score") >= min_score) & (F.col("area") > 0))


def segmented(views: DataFrame, phrases: list[tuple[str, str]], make_backend: Callable, min_score: float) -> DataFrame:
    """(view, place, phrase, concept, score, pixels, mask): every phrase of the vocabulary prompted in every view.

    ``views`` is (view, height, width, pixels); ``phrases`` lists (phrase, concept) in order. The backend gets an
    image and a phrase and returns (score, mask) pairs; masks that score too little or are empty are left out, a mask
    of another shape than its image is an error. Views stay where they are and go through a task one at a time.
    """

    def run(batches):
        backend = None
        for batch in batches:
            backend = backend or make_backend()
            for view, height, width, pixels in zip(*(batch.column(c) for c in range(4)), strict=True):
                image = pixels.values.to_numpy(zero_copy_only=False).reshape(height.as_py(), width.as_py())
                rows = []
                for phrase, concept in phrases:
                    for score, mask in backend(image, phrase):
                        if mask.shape != image.shape:
                            raise ValueError(f"a mask of shape {mask.shape} for an image of shape {image.shape}")
                        if score >= min_score and mask.any():
                            rows.append((view.as_py(), len(rows), phrase, concept, float(score), int(mask.sum()), np.packbits(mask).tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(_MASKS.names, r, strict=True)) for r in rows], schema=_MASKS)

    return views.select("view", "height", "width", "pixels").mapInArrow(run, "view bigint, place int, phrase string, concept string, score double, pixels int, mask binary")


_MASKS = pa.schema(
    [("view", pa.int64()), ("place", pa.int32()), ("phrase", pa.string()), ("concept", pa.string()), ("score", pa.float64()), ("pixels", pa.int32()), ("mask", pa.binary())]
)


def starts(length: int, crop: int, stride: int) -> list[int]:
    """Where crops begin: every ``stride``, and one that ends at the end."""
    last = max(0, length - crop)
    return sorted({*range(0, last + 1, stride), last})


def tiled(views: DataFrame, make_scorer: Callable, crop: int, stride: int) -> DataFrame:
    """(view, y, x, values): class values of every pixel, averaged over the overlapping crops that hold it.

    The scorer maps a crop (height, width) to an array (height, width, classes). Sums stay in the task of the view.
    """

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or make_scorer()
            for view, height, width, pixels in zip(*(batch.column(c) for c in range(4)), strict=True):
                image = pixels.values.to_numpy(zero_copy_only=False).reshape(height.as_py(), width.as_py())
                total, seen = None, np.zeros(image.shape)
                for y in starts(image.shape[0], crop, stride):
                    for x in starts(image.shape[1], crop, stride):
                        values = scorer(image[y : y + crop, x : x + crop])
                        total = np.zeros((*image.shape, values.shape[2])) if total is None else total
                        total[y : y + crop, x : x + crop] += values
                        seen[y : y + crop, x : x + crop] += 1
                mean = (total / seen[:, :, None]).reshape(-1, total.shape[2])
                at = np.indices(image.shape).reshape(2, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mean), view.as_py())), pa.array(at[0]), pa.array(at[1]), pa.array(list(mean), pa.list_(pa.float64()))], ["view", "y", "x", "values"]
                )

    return views.select("view", "height", "width", "pixels").mapInArrow(run, "view bigint, y int, x int, values array<double>")
