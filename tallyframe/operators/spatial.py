"""Voxel and radius graphs, neighbour search and geometry over points (entity, x, y, z).

All neighbourhoods are equi-joins on grid cells followed by an exact test, so a
point only meets points of the cells around it. A cell's name is the least entity in
it, which makes components of cells components of entities without another id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .graph import components

#: The 13 neighbour offsets after the origin; the other 13 are met from the other side.
HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
#: The same for cells of which the second neighbours count, too.
WIDE_HALF = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
#: Pairs of a camera and a point for a task, and the pairs that take the time of a camera's own work.
VIEW_PAIRS, VIEW_CAMERA = 200_000_000, 20_000
#: Points that are sent to each executor once (25 MB); of more, so many parts of the cameras may get a copy through a shuffle.
VIEW_POINTS, VIEW_PARTS = 1 << 20, 64
#: Points of a leaf, within which all distances are taken.
LEAF = 512
AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def cell(size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(size)).cast("bigint").alias(f"v{c}") for c in "xyz"]


def _offsets(offsets) -> Column:
    return F.explode(F.array(*[F.struct(*(F.lit(v).cast("bigint").alias(n) for v, n in zip(o, "xyz", strict=True))) for o in offsets]))


def voxel_components(points: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """The points with ``component``: cells that touch, corners included, are connected; the least entity names it."""
    by = by or []
    placed = points.select("*", *cell(size))
    keys = [*by, "vx", "vy", "vz"]
    cells = placed.groupBy(*keys).agg(F.min("entity").alias("node"))
    near = cells.select(*by, F.col("node").alias("u"), "vx", "vy", "vz", _offsets(HALF).alias("o")).select(
        *by, "u", *((F.col(f"v{c}") + F.col(f"o.{c}")).alias(f"v{c}") for c in "xyz")
    )
    edges = near.join(cells, keys).select("u", F.col("node").alias("v"))
    roots = components(edges)
    named = cells.join(roots, "node", "left").select(*keys, F.coalesce("root", "node").alias("component"))
    return placed.join(named, keys).drop("vx", "vy", "vz")


def component_sizes(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    return members.groupBy(*(by or []), "component").agg(F.count("*").alias("size"))


def kept_components(members: DataFrame, minimum: int, ratio: float, by: list[str] | None = None) -> DataFrame:
    """Members of components of at least max(minimum, ceil(ratio * largest)); of the largest if none is."""
    by = by or []
    sizes = component_sizes(members, by)
    largest = sizes.groupBy(*by).agg(F.max("size").alias("largest"))
    sizes = sizes.join(largest, by) if by else sizes.crossJoin(F.broadcast(largest))
    bound = F.greatest(F.lit(minimum), F.ceil(F.col("largest") * F.lit(ratio)))
    good = sizes.where((F.col("size") >= bound) | ((F.col("largest") < F.lit(minimum)) & (F.col("size") == F.col("largest"))))
    return members.join(good.select(*by, "component"), [*by, "component"], "left_semi")


def near_pairs(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(entity, other, distance) within the radius, each of ``points`` against all of ``others``."""
    left = points.select(F.col("entity"), "x", "y", "z", *cell(radius), _offsets(AROUND).alias("o")).select(
        "entity", "x", "y", "z", *((F.col(f"v{c}") + F.col(f"o.{c}")).alias(f"v{c}") for c in "xyz")
    )
    right = others.select(F.col("entity").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"), *cell(radius))
    square = sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz")
    return left.join(right, ["vx", "vy", "vz"]).where(square <= radius * radius).select("entity", "other", F.sqrt(square).alias("distance"))


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """(entity, component): points within the radius of one another are connected.

    Cells are so small that all points of one are connected. Neighbouring cells are
    connected if two of their outermost points are near enough, and can't be if their
    boxes are too far apart; points meet only for pairs of cells that are still in
    different components after that, so a dense cell costs no pairs of its points.
    """
    placed = materialize(points.select("entity", "x", "y", "z", *cell(radius / math.sqrt(3) * (1 - 1e-9))), "placed")
    at = F.struct("x", "y", "z")
    ends = [f(at, c) for c in "xyz" for f in (F.min_by, F.max_by)]
    box = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low_", F.min), ("high_", F.max))]
    cells = placed.groupBy("vx", "vy", "vz").agg(F.min("entity").alias("node"), F.count("*").alias("n"), F.array_distinct(F.array(*ends)).alias("ends"), *box)
    cells = materialize(cells.withColumn("all", F.col("n") == F.size("ends")), "cells")
    names = ["ends", "all", *(f"{n}_{c}" for c in "xyz" for n in ("low", "high"))]
    left = cells.select(F.col("node").alias("u"), *(F.col(n).alias(f"u_{n}") for n in names), "vx", "vy", "vz", _offsets(WIDE_HALF).alias("o"))
    left = left.select("u", *(f"u_{n}" for n in names), *((F.col(f"v{c}") + F.col(f"o.{c}")).alias(f"v{c}") for c in "xyz"))
    near = left.join(cells.withColumnRenamed("node", "v"), ["vx", "vy", "vz"])
    gap = [F.greatest(F.lit(0.0), F.col(f"u_low_{c}") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"u_high_{c}")) for c in "xyz"]
    square = lambda p, q: sum((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz")
    touch = F.exists("u_ends", lambda p: F.exists("ends", lambda q: square(p, q) <= radius * radius))
    pairs = near.where(sum(g * g for g in gap) <= radius * radius).select("u", "v", touch.alias("touch"), (F.col("u_all") & F.col("all")).alias("all"))
    pairs = materialize(pairs.where(F.col("touch") | ~F.col("all")), "cell_pairs")
    sure = pairs.where("touch").select("u", "v")
    roots = materialize(components(sure), "roots")
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    open_ = pairs.where("not touch").join(root("u"), "u", "left").join(root("v"), "v", "left")
    open_ = materialize(open_.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v"), "open")
    named = placed.join(cells.select("vx", "vy", "vz", "node"), ["vx", "vy", "vz"])
    side = lambda end: named.select(F.col("node").alias(end), F.struct("x", "y", "z").alias(f"at_{end}"))
    met = open_.join(side("u"), "u").join(side("v"), "v").where(square(F.col("at_u"), F.col("at_v")) <= radius * radius).select("u", "v").distinct()
    linked = roots if open_.isEmpty() else components(sure.union(met)).select("node", "root")
    nowhere = placed.where(F.col("vx").isNull() | F.col("vy").isNull() | F.col("vz").isNull()).select("entity", F.col("entity").alias("component"))
    return named.join(linked, "node", "left").select("entity", F.coalesce("root", "node").alias("component")).union(nowhere)


def nearest(points: DataFrame, others: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest of ``others`` within the radius; smaller ids first on ties."""
    order = Window.partitionBy("entity").orderBy(F.round("distance", 9), "other")
    return near_pairs(points, others, radius).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _nearest_squares(at: np.ndarray, names: np.ndarray, to: np.ndarray, other: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """Per row of ``at``: the k least squared distances within its bound to points of another name; infinite where there are fewer."""
    with np.errstate(over="ignore"):
        dx, dy, dz = (at[:, None, c] - to[None, :, c] for c in range(3))
        square = dx * dx + dy * dy + dz * dz
    square[(square > bound[:, None]) | (names[:, None] == other[None, :])] = np.inf
    if square.shape[1] < k:
        square = np.pad(square, ((0, 0), (0, k - square.shape[1])), constant_values=np.inf)
    return np.sort(np.partition(square, k - 1, axis=1)[:, :k], axis=1)


def _hilbert(steps: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that sort rows of three unsigned numbers below 2**depth along a Hilbert curve, by Skilling's transposition.

    What follows one another on it is near in space, so runs have small boxes.
    """
    x = [steps[:, c].copy() for c in range(3)]
    for bit in range(depth - 1, 0, -1):
        q, below = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for c in range(3):
            on = (x[c] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[c]) & below)
            x[0] ^= np.where(on, below, swap)
            if c:
                x[c] ^= swap
    x[1] ^= x[0]
    x[2] ^= x[1]
    turn = np.zeros_like(x[0])
    for bit in range(depth - 1, 0, -1):
        turn ^= np.where((x[2] & np.uint64(1 << bit)) != 0, np.uint64((1 << bit) - 1), np.uint64(0))
    whole = np.stack([v ^ turn for v in x], axis=1).astype(">u8", order="C").view(np.uint8).reshape(len(steps), 3, 8)
    return np.packbits(np.unpackbits(whole, axis=2).transpose(0, 2, 1).reshape(len(steps), 192), axis=1)


def neighbour_distance(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(entity, distance): how far the k-th nearest other point is, for entities that have k within the radius.

    Points in the order of a Hilbert curve are cut into leaves. The k-th distance within its leaf bounds how
    far a point has to look, and it visits only leaves whose boxes are nearer than that, so the work follows the
    points' own density, whatever the radius. Of points in one place, as many go on as can matter to any other.
    """
    placed = points.select("entity", "x", "y", "z").where("entity is not null")
    placed = placed.where((F.abs("x") < math.inf) & (F.abs("y") < math.inf) & (F.abs("z") < math.inf))
    again, place = Window.partitionBy("x", "y", "z", "entity").orderBy("entity"), Window.partitionBy("x", "y", "z").orderBy("entity")
    few = placed.withColumn("n", F.row_number().over(again)).where(F.col("n") <= k).withColumn("n", F.dense_rank().over(place)).where(F.col("n") <= k + 1)
    ends = placed.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xyz")).first()
    low, high = (np.array([ends[f"{f}_{c}"] or 0.0 for c in "xyz"]) for f in ("min", "max"))

    def keyed(batches):
        for b in batches:
            with np.errstate(all="ignore"):
                share = np.nan_to_num((b[["x", "y", "z"]].to_numpy(float) - low) / np.where(high > low, high - low, 1.0))
            curve = _hilbert((share * (2**52 - 1)).astype(np.uint64), 52)
            yield b.assign(curve=[row.tobytes() for row in curve])[["entity", "x", "y", "z", "curve"]]

    def leaves(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for start in range(0, len(b), LEAF):
                own = b.iloc[start : start + LEAF]
                at, names = own[["x", "y", "z"]].to_numpy(float), own["entity"].to_numpy()
                found = _nearest_squares(at, names, at, names, k, np.full(len(own), radius * radius))
                yield own[["entity", "x", "y", "z"]].assign(leaf=number, reach=np.minimum(found[:, -1], radius * radius), near=[list(np.sqrt(r[r < np.inf])) for r in found])
                number += 1

    kind = dict(points.dtypes)["entity"]
    curve = materialize(few.select("entity", "x", "y", "z").mapInPandas(keyed, f"entity {kind}, x double, y double, z double, curve binary"), "curve")
    order = curve.repartitionByRange("curve").sortWithinPartitions("curve")
    leaf = materialize(order.mapInPandas(leaves, f"entity {kind}, x double, y double, z double, leaf long, reach double, near array<double>"), "leaves")

    boxes = materialize(leaf.groupBy("leaf").agg(F.max("reach").alias("reach"), *(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz")), "boxes")
    gap = lambda low, high: sum(g * g for g in (F.greatest(F.lit(0.0), F.col(f"low_{c}") - high(c), low(c) - F.col(f"high_{c}")) for c in "xyz"))
    mine = boxes.select(F.col("leaf").alias("home"), F.col("reach").alias("far"), *(F.col(f"{n}_{c}").alias(f"{n}{c}") for n in ("low", "high") for c in "xyz"))
    beside = mine.crossJoin(boxes.drop("reach")).where((F.col("home") != F.col("leaf")) & (gap(lambda c: F.col(f"low{c}"), lambda c: F.col(f"high{c}")) <= F.col("far")))
    beside = beside.select("home", "leaf", *(f"{n}_{c}" for n in ("low", "high") for c in "xyz"))
    visits = leaf.withColumnRenamed("leaf", "home").join(beside, "home").where(gap(F.col, F.col) <= F.col("reach")).select("leaf", "entity", "x", "y", "z", "reach")

    def visited(guests: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        to, other, out = own[["ox", "oy", "oz"]].to_numpy(float), own["other"].to_numpy(), []
        for start in range(0, len(guests), 4 * LEAF):
            some = guests.iloc[start : start + 4 * LEAF]
            names = some["entity"].to_numpy()
            found = _nearest_squares(some[["x", "y", "z"]].to_numpy(float), names, to, other, k, some["reach"].to_numpy())
            row, column = np.nonzero(found < np.inf)
            out.append(pd.DataFrame({"entity": names[row], "distance": np.sqrt(found[row, column])}))
        return pd.concat(out) if out else pd.DataFrame({"entity": other[:0], "distance": np.empty(0)})

    hosts = leaf.select(F.col("leaf").alias("host"), F.col("entity").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    others = visits.groupBy("leaf").cogroup(hosts.groupBy("host")).applyInPandas(visited, f"entity {kind}, distance double")
    # Where more than k entities share a place, each has k others at no distance, also those that went no further.
    crowded = leaf.groupBy("x", "y", "z").agg(F.countDistinct("entity").alias("n")).where(F.col("n") > k).select("x", "y", "z")
    same = placed.join(crowded, ["x", "y", "z"], "left_semi").select("entity", F.explode(F.array_repeat(F.lit(0.0), k)).alias("distance"))
    found = leaf.select("entity", F.explode("near").alias("distance")).union(others).union(same)
    nth = F.row_number().over(Window.partitionBy("entity").orderBy("distance"))
    return found.withColumn("place", nth).where(F.col("place") <= k).where(F.col("place") == k).select("entity", "distance")


def consistent_neighbours(found: DataFrame, labels: DataFrame, target: Column, min_same: int, min_fraction: float, max_ratio: float) -> DataFrame:
    """Per entity: neighbours of the target class, their share, and whether the nearest of them is near enough
    compared with the nearest of another class."""
    j = found.join(labels.select(F.col("entity").alias("other"), F.col("label").alias("theirs")), "other").join(labels.select("entity", "label"), "entity")
    same = F.col("theirs") == target
    rows = j.groupBy("entity").agg(
        F.count("*").alias("neighbours"),
        F.count_if(same).alias("same"),
        F.min(F.when(same, F.col("distance"))).alias("nearest_same"),
        F.min(F.when(~same, F.col("distance"))).alias("nearest_other"),
    )
    near = F.col("nearest_same").isNotNull() & (F.col("nearest_other").isNull() | (F.col("nearest_same") <= F.col("nearest_other") * max_ratio))
    accepted = (F.col("same") >= min_same) & (F.col("same") / F.col("neighbours") >= min_fraction) & near
    return rows.withColumn("accepted", accepted)


def seeded(members: DataFrame, anchors: DataFrame, min_precision: float) -> DataFrame:
    """Components that hold an anchor and whose share of anchors reaches the bound."""
    j = members.join(anchors.select("entity", F.lit(1).alias("anchor")), "entity", "left")
    rows = j.groupBy("component").agg(F.count("*").alias("size"), F.count("anchor").alias("anchors"))
    return rows.where((F.col("anchors") > 0) & (F.col("anchors") / F.col("size") >= min_precision))


def seed_guard(members: DataFrame, seeds: DataFrame, target: int) -> DataFrame:
    """Per component: accepted if it holds a seed of the target and none of another class."""
    j = members.join(seeds.select("entity", "seed"), "entity", "left")
    return j.groupBy("component").agg(
        F.count("*").alias("size"),
        F.count_if(F.col("seed") == target).alias("matching"),
        F.count_if((F.col("seed") > 0) & (F.col("seed") != target)).alias("conflicting"),
    ).withColumn("accepted", (F.col("matching") > 0) & (F.col("conflicting") == 0))


def voxel_size(points: DataFrame, scale: str, multiplier: float, minimum: float, maximum: float, by: str) -> DataFrame:
    """Clamped median of exp(clipped log-scale) times a factor, per class."""
    value = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(5.0), F.col(scale))))
    return points.groupBy(by).agg(F.greatest(F.lit(minimum), F.least(F.lit(maximum), F.percentile(value, 0.5) * multiplier)).alias("size"))


def robust_extents(points: DataFrame, by: str, quantile: float = 0.05) -> DataFrame:
    """Per group: extents along the principal axes between two quantiles, largest first.

    Sums of products come from a grouped aggregate; the quantiles along the axes need
    the group's points, so groups should be objects, not whole tables.
    """

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        xyz = mine[["x", "y", "z"]].to_numpy(float)
        centred = xyz - np.median(xyz, axis=0)
        axes = np.linalg.eigh(centred.T @ centred / max(1, len(xyz)))[1]
        low, high = np.quantile(centred @ axes, [quantile, 1 - quantile], axis=0)
        e = np.sort(high - low)[::-1]
        return pd.DataFrame({by: [mine[by].iloc[0]], "n": [len(xyz)], "e1": [e[0]], "e2": [e[1]], "e3": [e[2]]})

    kind = dict(points.dtypes)[by]
    return points.select(by, "x", "y", "z").groupBy(by).applyInPandas(run, f"{by} {kind}, n long, e1 double, e2 double, e3 double")


def shapes_match(a, b, max_size_ratio: float, max_shape_ratio: float) -> Column:
    """Whether two extents have sizes and proportions within the ratios."""
    ratio = lambda p, q: F.greatest(p, q) / F.greatest(F.least(p, q), F.lit(1e-9))
    size = ratio(a[0], b[0]) <= max_size_ratio
    shape = F.greatest(ratio(a[1] / a[0], b[1] / b[0]), ratio(a[2] / a[0], b[2] / b[0])) <= max_shape_ratio
    return size & shape


def angle_between(position: list[Column], other: list[Column]) -> Column:
    dot = sum(p * q for p, q in zip(position, other, strict=True))
    norm = F.sqrt(sum(p * p for p in position)) * F.sqrt(sum(q * q for q in other))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm)))))


def pose_distance(scale: float, weight: float) -> Column:
    """Of columns px.. and yaw against qx.. and qyaw."""
    square = sum((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz")
    turn = F.abs(F.pmod(F.col("yaw") - F.col("qyaw") + math.pi, F.lit(2 * math.pi)) - math.pi)
    return F.sqrt(square / (scale * scale) + F.pow(weight * turn / math.pi, 2))


def projected(focal: float, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """(u, v, depth, inside) of a point seen by a camera at p that is turned by yaw about the vertical axis."""
    dx, dy, dz = (F.col(c) - F.col(f"p{c}") for c in "xyz")
    depth = F.cos("yaw") * dz + F.sin("yaw") * dx
    side = F.cos("yaw") * dx - F.sin("yaw") * dz
    front = depth > 1e-6
    u = F.when(front, F.lit(width / 2) + focal * side / F.when(front, depth))
    v = F.when(front, F.lit(height / 2) + focal * dy / F.when(front, depth))
    inside = F.coalesce(front & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))
    return u, v, depth, inside


def view_statistics(points: DataFrame, cameras: DataFrame, focal: float, width: float, height: float, quantile: float | None = None) -> DataFrame:
    """(observer, front, inside, depth): the shares of points in front of its cameras and inside their images, and the quantile of the depths, if any.

    Every camera meets every point, but no row is made for a pair: a task holds the points' coordinates (24 bytes a
    point) and takes its cameras one at a time. Up to ``VIEW_POINTS`` points are broadcast, and nothing but the cameras
    is shuffled; more go to each of at most ``VIEW_PARTS`` parts of the cameras.
    """
    n_points = points.count()
    parts = max(1, math.ceil((n_points + VIEW_CAMERA) * cameras.count() / VIEW_PAIRS))

    def run(mine: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        # A point without x or z has no depth; it still counts among those that an image could show.
        placed = seen[seen["placed"]]
        x, y, z = (placed[c].to_numpy(float) for c in "xyz")
        rows = []
        with np.errstate(all="ignore"):
            for observer, own in mine.groupby("observer", sort=False, dropna=False) if len(seen) else ():
                front = inside = 0
                depths = []
                for px, py, pz, yaw in own.loc[own["posed"], ["px", "py", "pz", "yaw"]].to_numpy(float) if len(x) else ():
                    cos, sin = (math.cos(yaw), math.sin(yaw)) if math.isfinite(yaw) else (math.nan, math.nan)
                    dx, dz = x - px, z - pz
                    depth = cos * dz + sin * dx
                    ahead = ~(depth <= 1e-6)  # Spark and SQL take NaN for the largest number
                    depths.append(depth)
                    front += np.count_nonzero(ahead)
                    if ahead.any():
                        far = depth[ahead]
                        v = height / 2 + focal * (y[ahead] - py) / far
                        within = (v >= 0) & (v < height)
                        if within.any():
                            u = width / 2 + focal * (cos * dx[ahead][within] - sin * dz[ahead][within]) / far[within]
                            inside += np.count_nonzero((u >= 0) & (u < width))
                n = sum(map(len, depths))
                bound = None
                if n and quantile is not None:
                    at = (n - 1) * quantile
                    low = math.floor(at)
                    ranked = np.partition(np.concatenate(depths), [low, min(low + 1, n - 1)])
                    bound = ranked[low] if at == low else (low + 1 - at) * ranked[low] + (at - low) * ranked[low + 1]
                rows.append((observer, front / n if n else None, inside / (len(own) * len(seen)), bound))
        out = pd.DataFrame(rows, columns=["observer", "front", "inside", "depth"])
        return out.astype({"front": float, "inside": float, "depth": float})

    posed = F.col("px").isNotNull() & F.col("pz").isNotNull() & F.col("yaw").isNotNull()
    eyes = cameras.select("observer", "px", "py", "pz", "yaw", posed.alias("posed"))
    places = points.select("x", "y", "z", (F.col("x").isNotNull() & F.col("z").isNotNull()).alias("placed"))
    schema = f"observer {dict(cameras.dtypes)['observer']}, front double, inside double, depth double"
    if n_points <= VIEW_POINTS:
        sent = points.sparkSession.sparkContext.broadcast(places.toArrow().to_pandas())

        def held(batches):
            if mine := list(batches):
                yield run(pd.concat(mine, ignore_index=True), sent.value)

        return eyes.repartition(parts, "observer").mapInPandas(held, schema)
    parts = min(VIEW_PARTS, parts)
    eyes = eyes.withColumn("part", F.pmod(F.xxhash64("observer"), F.lit(parts)))
    places = places.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return eyes.groupBy("part").cogroup(places.groupBy("part")).applyInPandas(run, schema)
