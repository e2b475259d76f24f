"""Quantile profiles, histograms, empirical ranks and box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def profile(df: DataFrame, column: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean and linearly interpolated quantiles of the finite values."""
    x = F.when(~F.isnan(F.col(column).cast("double")) & (F.abs(F.col(column).cast("double")) < float("inf")), F.col(column).cast("double"))
    q = F.percentile(x, list(QUANTILES))
    out = df.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), q.alias("q"))
    return out.select(*(by or []), "n", "mean", *(F.round(F.get("q", F.lit(i)), digits).alias(f"p{int(p * 100):02d}") for i, p in enumerate(QUANTILES)))


def bin_of(x: Column, bins: int) -> Column:
    """Bin of a value in [0, 1]; 1 falls into the last."""
    return F.least(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")


def cumulative(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n, cdf) for every bin, also empty ones; the window runs over ``bins`` rows."""
    spark = df.sparkSession
    counts = df.groupBy(bin_of(F.col(column), bins).alias("bin")).agg(F.count("*").alias("n"))
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    order = Window.orderBy("bin")
    return full.withColumn("cdf", F.sum("n").over(order) / F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def profile_bins(cdf: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """For each target share t: the first bin whose cdf reaches 1 - t, so that about t of the values lie in it or above."""
    t = cdf.sparkSession.createDataFrame([(x,) for x in targets], "target double")
    return cdf.crossJoin(F.broadcast(t)).where(F.round("cdf", 9) >= F.round(1 - F.col("target"), 9)).groupBy("target").agg(F.min("bin").alias("bin"))


def box_iou(p: list[Column], q: list[Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(p[2], q[2]) - F.greatest(p[0], q[0]))
    h = F.greatest(F.lit(0.0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return F.coalesce(F.try_divide(w * h, area(p) + area(q) - w * h), F.lit(0.0))


def pixel_intersection(p: list[Column], q: list[Column]) -> Column:
    """Pixels in both of two boxes of inclusive corners."""
    w, h = F.least(p[2], q[2]) - F.greatest(p[0], q[0]) + 1, F.least(p[3], q[3]) - F.greatest(p[1], q[1]) + 1
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def corners(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> list[Column]:
    """Pixel corners of a box given by centre and size in [0, 1], clamped to the image."""
    clamp = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(m)))
    return [clamp((cx - w / 2) * width, width), clamp((cy - h / 2) * height, height), clamp((cx + w / 2) * width, width), clamp((cy + h / 2) * height, height)]


def resized(width: Column, height: Column, short: int) -> tuple[Column, Column]:
    """Size with the shorter side at ``short``, halves up."""
    low = F.least(width, height)
    half_up = lambda v: F.floor(v * short / low + 0.5).cast("bigint")
    return half_up(width), half_up(height)


def scaled(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    """Size no wider than ``limit``, halves to even, at least one pixel."""
    factor = F.least(F.lit(1.0), F.lit(float(limit)) / width)
    even = lambda v: F.greatest(F.lit(1), F.rint(v * factor).cast("bigint"))
    return even(width), even(height)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often, or in whatever lambda, the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    """Of an array, stable; linear in its length."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    share = lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))
    return let(values, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), share)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def entropy_confidence(p: Column) -> Column:
    """1 minus the entropy of a distribution over its largest possible value."""
    h = F.aggregate(F.transform(p, lambda v: F.when(v > 0, -v * F.ln(v)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    return 1 - h / F.ln(F.size(p).cast("double"))


def min_max(c: Column, window) -> Column:
    """Scaled to [0, 1] within the window; 1 where all are equal."""
    low, high = F.min(c).over(window), F.max(c).over(window)
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((c - low) / (high - low))
