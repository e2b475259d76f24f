"""Guarded refinement of base labels by groups of new evidence.

Everything that looks at entities is a DataFrame over (group, entity): robust and
unique claims, the base instance that anchors a group, competing classes, spatial
components, robust envelopes. What is left of a group is one row of measures.
Groups are some hundreds of proposed objects; their rows are decided in order on the
driver, because an accepted group may serve later ones as a prototype or parent.
The decisions go back as a small table, and changed entities take the label of the
last group that changes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import labels as lb
from . import spatial as sp


@dataclass(frozen=True)
class Bounds:
    """Thresholds, inclusive; shares are between zero and one. The defaults."""

    min_anchor: int = 50
    min_coverage: float = 0.30
    min_precision: float = 0.10
    min_proposals: int = 2
    min_views: int = 2
    voxel: float = 0.2
    envelope_quantile: float = 0.01
    envelope_margin: float = 0.05
    halo_ratio: float = 0.75
    halo_precision: float = 0.75
    nested_containment: float = 0.80
    nested_margin: float = 0.25
    nested_source_ratio: float = 2.0
    nested_overlap: float = 0.10
    prototype_robust: float = 0.50
    prototype_views: int = 3
    prototype_strong_views: int = 5
    prototype_competing: float = 0.50
    prototype_risk: float = 0.40
    prototype_ambiguous: float = 0.90
    prototype_shape: float = 2.50
    prototype_size: float = 3.00
    component_ratio: float = 0.10


def flagged(sources: DataFrame, claims: DataFrame, base: DataFrame) -> DataFrame:
    """(grp, class_id, entity) with robust and unique flags, the base label and its class.

    ``claims`` is (class_id, entity) of robust evidence; a claim is unique if no
    other class claims the entity. ``base`` is (entity, label, base_class).
    """
    counted = claims.groupBy("entity").agg(F.count("*").alias("claims"))
    j = sources.join(claims.select("class_id", "entity", F.lit(True).alias("robust")), ["class_id", "entity"], "left")
    j = j.join(counted, "entity", "left").join(base, "entity", "left")
    return j.select(
        "grp", "class_id", "entity", F.coalesce("robust", F.lit(False)).alias("robust"), (F.coalesce("claims", F.lit(0)) == 1).alias("unique"),
        F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("base_class", F.lit(0)).alias("base_class"),
    )


def anchors(flags: DataFrame, base: DataFrame) -> DataFrame:
    """Per group: sizes, and the base label of its own class that its guarded entities overlap most."""
    guarded = F.col("robust") & F.col("unique")
    sizes = flags.groupBy("grp", "class_id").agg(F.count("*").alias("source"), F.count_if(F.col("robust")).alias("robust"), F.count_if(guarded).alias("guarded"))
    own = flags.where(guarded & (F.col("label") > 0) & (F.col("base_class") == F.col("class_id"))).groupBy("grp", "label").agg(F.count("*").alias("overlap"))
    best = own.groupBy("grp").agg(F.max(F.struct("overlap", (-F.col("label")).alias("l"))).alias("b"))
    instance = base.where("label > 0").groupBy("label").agg(F.count("*").alias("anchor_size"))
    j = sizes.join(best.select("grp", (-F.col("b.l")).alias("anchor"), F.col("b.overlap").alias("overlap")), "grp", "left")
    j = j.join(instance.withColumnRenamed("label", "anchor"), "anchor", "left").fillna(0, ["anchor", "overlap", "anchor_size"])
    return j.withColumn("coverage", F.col("overlap") / F.greatest("anchor_size", F.lit(1))).withColumn("precision", F.col("overlap") / F.greatest("guarded", F.lit(1)))


def kept_in_space(core: DataFrame, points: DataFrame, anchored: DataFrame, b: Bounds) -> DataFrame:
    """(grp, entity, by_anchor, by_size) of the core entities (of flags) whose component passes either rule."""
    guarded = core.join(points, "entity").join(anchored.select("grp", "anchor"), "grp")
    members = materialize(sp.voxel_components(guarded.select("grp", "entity", "x", "y", "z", (F.col("label") == F.col("anchor")).alias("is_anchor")), b.voxel, ["grp"]), "members")
    c = members.groupBy("grp", "component").agg(F.count("*").alias("size"), F.count_if(F.col("is_anchor")).alias("hits"))
    largest = c.groupBy("grp").agg(F.max("size").alias("largest"))
    c = c.join(largest, "grp").select(
        "grp", "component",
        ((F.col("hits") > 0) & (F.col("hits") / F.col("size") >= b.min_precision)).alias("by_anchor"),
        ((F.col("size") >= F.greatest(F.lit(b.min_anchor), F.ceil(F.col("largest") * b.component_ratio))) | ((F.col("largest") < b.min_anchor) & (F.col("size") == F.col("largest")))).alias("by_size"),
    )
    return members.join(c, ["grp", "component"]).select("grp", "entity", "by_anchor", "by_size", "is_anchor")


def envelopes(base: DataFrame, points: DataFrame, wanted: DataFrame, quantile: float) -> DataFrame:
    """(anchor, frame): centre, axes and quantile bounds of each wanted base instance, 18 numbers."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        xyz = mine[["x", "y", "z"]].to_numpy(float)
        centre = np.median(xyz, axis=0)
        axes = np.linalg.eigh((xyz - centre).T @ (xyz - centre) / max(1, len(xyz)))[1]
        low, high = np.quantile((xyz - centre) @ axes, [quantile, 1 - quantile], axis=0)
        return pd.DataFrame({"anchor": [int(mine["anchor"].iloc[0])], "frame": [[*centre, *axes.T.ravel(), *low, *high]]})

    inside = base.join(wanted.select(F.col("anchor").alias("label")).distinct(), "label", "left_semi").join(points, "entity")
    return inside.select(F.col("label").cast("int").alias("anchor"), "x", "y", "z").groupBy("anchor").applyInPandas(run, "anchor int, frame array<double>")


def within(frame: str, margin: float):
    """Whether x, y, z lie in a frame whose bounds are widened by a share of the extents."""
    at = lambda k: F.get(frame, F.lit(k))
    good = F.lit(True)
    for axis in range(3):
        v = sum((F.col(c) - at(i)) * at(3 + 3 * axis + i) for i, c in enumerate("xyz"))
        low, high = at(12 + axis), at(15 + axis)
        room = (high - low) * margin
        good = good & (v >= low - room) & (v <= high + room)
    return good


def nesting(flags: DataFrame, base: DataFrame, points: DataFrame, measures: DataFrame, frames: DataFrame, b: Bounds) -> DataFrame:
    """(child, parent, containment, overlap, overlap_share): a child's anchor in a parent's widened envelope, and under
    the parent's own source; only anchored groups of different classes."""
    g = measures.where("anchor > 0").select("grp", "class_id", "anchor")
    child = g.select(F.col("grp").alias("child"), F.col("class_id").alias("cc"), F.col("anchor").alias("ca"))
    parent = g.select(F.col("grp").alias("parent"), F.col("class_id").alias("pc"), F.col("anchor").alias("pa"))
    pair = child.join(parent, (F.col("cc") != F.col("pc")) & (F.col("ca") != F.col("pa")))
    at = base.select("entity", F.col("label").alias("ca")).join(points, "entity")
    j = pair.join(at, "ca").join(frames.withColumnRenamed("anchor", "pa"), "pa")
    source = flags.select(F.col("grp").alias("parent"), "entity", F.lit(1).alias("hit"))
    j = j.join(source, ["parent", "entity"], "left")
    return j.groupBy("child", "parent").agg(
        F.avg(within("frame", b.nested_margin).cast("double")).alias("containment"), F.count("hit").alias("overlap"), (F.count("hit") / F.count("*")).alias("overlap_share")
    )


def contested(flags: DataFrame, points: DataFrame, things: DataFrame, classes: DataFrame, measures: DataFrame, taken: DataFrame | None, b: Bounds):
    """(core, measures) of each group's robust entities, also those that other classes claim, but for what earlier groups took.

    ``taken`` is (entity, grp) of accepted groups.
    """
    core = flags.where("robust")
    if taken is not None:
        first = taken.groupBy("entity").agg(F.min("grp").alias("by"))
        core = core.join(first, "entity", "left").where("by is null or by >= grp").drop("by")
    core = materialize(core, "contested")
    rival = lb.competing(core.select(F.col("grp").alias("candidate"), F.col("class_id").alias("target"), "entity"), things, classes)
    extents = sp.robust_extents(core.select("grp", "entity").join(points, "entity"), "grp", 0.05)
    kept = materialize(kept_in_space(core, points, measures, b), "kept")
    found = kept.groupBy("grp").agg(F.count_if(F.col("by_size")).alias("wide_kept"))
    out = (
        core.groupBy("grp").agg(F.count("*").alias("wide"))
        .join(rival.select(F.col("candidate").alias("grp"), F.col("class_fraction").alias("wide_fraction"), F.col("risk").alias("wide_risk")), "grp", "left")
        .join(extents.select("grp", *(F.col(f"e{k}").alias(f"w{k}") for k in (1, 2, 3))), "grp", "left")
        .join(found, "grp", "left")
    )
    return kept.select("grp", "entity", F.col("by_size").alias("by_wide")), out


def _shape_matches(a, prototypes, b: Bounds) -> bool:
    if a is None:
        return False
    ratio = lambda p, q: max(p, q) / max(min(p, q), 1e-9)
    return any(
        ratio(a[0], p[0]) <= b.prototype_size and max(ratio(a[i] / max(a[0], 1e-9), p[i] / max(p[0], 1e-9)) for i in (1, 2)) <= b.prototype_shape
        for p in prototypes
    )


def decide(rows: list[dict], nested: list[dict], things: set[int], first_id: int, b: Bounds) -> tuple[list[tuple], bool]:
    """(grp, mode, reason, label, parent) of every group in order of their ids, and whether contested entities were asked for.

    The label is 0 if a group changes nothing. A thing that nothing anchors, but that many views support, may fill up
    with entities that other classes claim: where its class has prototypes, nearly all that lies below it is one
    competing object, and the whole has the shape of a prototype, it is judged by the whole.
    """
    shapes: dict[int, list] = {}
    asked = False
    regions: dict[int, dict] = {}
    inside = {(n["child"], n["parent"]): n for n in nested}
    out, label = [], first_id
    for r in sorted(rows, key=lambda r: r["grp"]):
        thing, c = r["class_id"] in things, r["class_id"]
        if r["proposals"] < b.min_proposals or r["views"] < b.min_views:
            out.append((r["grp"], "rejected", "support", 0, None))
            continue
        overlap_ok, coverage_ok = r["overlap"] >= b.min_anchor, r["coverage"] >= b.min_coverage
        fallback = thing and overlap_ok and r["precision"] >= b.min_precision
        anchored = overlap_ok and (coverage_ok or fallback)
        parent, best = None, 0.0
        if thing and r["anchor"]:
            for p in regions.values():
                n = inside.get((r["grp"], p["grp"]))
                if n and p["class_id"] != c and n["containment"] >= b.nested_containment and p["source"] / max(r["source"], 1) >= b.nested_source_ratio and n["overlap"] >= b.min_anchor and n["overlap_share"] >= b.nested_overlap and n["containment"] > best:
                    parent, best = p["grp"], n["containment"]
        if parent is not None:
            out.append((r["grp"], "nested", "", label, parent))
            label += 1
            continue
        known = shapes.get(c, [])
        core, fraction, risk, kept = r["guarded"], r["class_fraction"], r["risk"], r["kept_size"]
        shape = (r["e1"], r["e2"], r["e3"]) if r["e1"] is not None else None
        recovered = False
        if thing and not anchored and known and r["views"] >= b.prototype_strong_views:
            asked = True
            whole = (r["w1"], r["w2"], r["w3"]) if r["w1"] is not None else None
            large = r["wide"] >= b.min_anchor and r["wide"] / max(r["source"], 1) >= b.prototype_robust
            recovered = large and r["wide_fraction"] >= b.prototype_ambiguous and _shape_matches(whole, known, b)
        if recovered:
            core, fraction, risk, kept, shape = r["wide"], r["wide_fraction"], r["wide_risk"], r["wide_kept"], whole
        strong = bool(known) and r["views"] >= b.prototype_strong_views and fraction <= b.prototype_competing and risk <= b.prototype_risk
        by_prototype = (
            thing and not anchored and core >= b.min_anchor and core / max(r["source"], 1) >= b.prototype_robust
            and r["views"] >= max(b.min_views, b.prototype_views) and (_shape_matches(shape, known, b) or strong)
        )
        if not anchored and not by_prototype:
            out.append((r["grp"], "rejected", "anchor_overlap" if not overlap_ok else "anchor_coverage" if not coverage_ok else "prototype", 0, None))
            continue
        if not (r["kept_anchor"] if anchored else kept):
            out.append((r["grp"], "rejected", "no_component", 0, None))
            continue
        if anchored and shape:
            shapes.setdefault(c, []).append(shape)
        if anchored and thing:
            regions[r["grp"]] = r
        out.append((r["grp"], ("anchor" if coverage_ok else "precision") if anchored else "recovered" if recovered else "prototype", "", label, None))
        label += 1
    return out, asked


def refined(sources: DataFrame, claims: DataFrame, base: DataFrame, points: DataFrame, groups: DataFrame, things: set[int], b: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """(entity, base, label) and the decisions (grp, mode, reason, label, changed).

    ``groups`` is (grp, proposals, views); ``things`` are the classes of countable objects.
    """
    spark = base.sparkSession
    flags = materialize(flagged(sources, claims, base), "flags")
    measures = anchors(flags, base)
    classes = base.select("label", F.col("base_class").alias("class_id")).where("label > 0").distinct()
    thing_base = base.where(F.col("base_class").isin(*things)) if things else base.limit(0)
    guarded = flags.where("robust and unique")
    rival = lb.competing(guarded.select(F.col("grp").alias("candidate"), F.col("class_id").alias("target"), "entity"), thing_base.select("entity", "label"), classes)
    extents = sp.robust_extents(guarded.select("grp", "entity").join(points, "entity"), "grp", 0.05).drop("n")
    kept = materialize(kept_in_space(guarded, points, measures, b), "kept")
    found = kept.groupBy("grp").agg(F.count_if(F.col("by_anchor")).alias("kept_anchor"), F.count_if(F.col("by_size")).alias("kept_size"), F.count_if(F.col("by_anchor") & F.col("is_anchor")).alias("kept_hits"))
    measures = materialize(
        measures.join(groups, "grp")
        .join(rival.select(F.col("candidate").alias("grp"), "class_fraction", "risk"), "grp", "left")
        .join(extents, "grp", "left")
        .join(found, "grp", "left")
        .fillna(0, ["class_fraction", "risk", "kept_anchor", "kept_size", "kept_hits"]),
        "measures",
    )
    frames = materialize(envelopes(base, points, measures.where("anchor > 0"), b.envelope_quantile), "frames")
    nested = nesting(flags, base, points, measures.where(F.col("class_id").isin(*things)) if things else measures.limit(0), frames, b)
    first = (base.agg(F.max("label")).first()[0] or 0) + 1
    links = [n.asDict() for n in nested.collect()]
    schema = "grp int, mode string, reason string, label int, parent int"
    of_group = measures.select("grp", "class_id", "anchor", "anchor_size", "source", "kept_anchor", "kept_hits")

    def claimed(taken: list[tuple], wide: DataFrame) -> DataFrame:
        """(entity, grp, new, class_id, base_class) that the accepted groups take."""
        d = spark.createDataFrame(taken, schema).withColumnRenamed("label", "new").join(of_group, "grp").join(frames, "anchor", "left")
        thing = F.col("class_id").isin(*things) if things else F.lit(False)
        base_thing = F.col("base_class").isin(*things) if things else F.lit(False)
        is_anchored = F.col("mode").isin("anchor", "precision")
        j = (
            flags.join(d.drop("class_id"), "grp")
            .join(points, "entity", "left")
            .join(kept.select("grp", "entity", "by_anchor", "by_size"), ["grp", "entity"], "left")
            .join(wide, ["grp", "entity"], "left")
            .withColumn("in_frame", F.coalesce(within("frame", b.envelope_margin), F.lit(False)))
        )
        by_mode = F.when(is_anchored, F.col("by_anchor")).when(F.col("mode") == "prototype", F.col("by_size")).when(F.col("mode") == "recovered", F.col("by_wide"))
        core = F.coalesce(by_mode, F.lit(False))
        # Contested and weak entities of other objects come along where the group is as large as its anchor.
        halo = is_anchored & thing & (F.col("source") / F.greatest("anchor_size", F.lit(1)) >= b.halo_ratio) & base_thing & (F.col("base_class") != F.col("class_id")) & F.col("in_frame")
        precise = F.col("kept_hits") / F.greatest("kept_anchor", F.lit(1)) >= b.halo_precision
        member = core | (halo & F.col("robust") & ~F.col("unique")) | (halo & ~F.col("robust") & precise)
        allowed = F.when(is_anchored & thing, base_thing | F.col("in_frame")).when(~thing, ~base_thing).otherwise(F.lit(True))
        return j.where(member & allowed & (F.col("new") > 0) & (F.col("mode") != "nested")).select("entity", "grp", "new", "class_id", "base_class")

    plain = [r.asDict() | dict.fromkeys(("wide", "wide_fraction", "wide_risk", "wide_kept"), 0) | dict.fromkeys(("w1", "w2", "w3")) for r in measures.collect()]
    decided, asked = decide(plain, links, things, first, b)
    wide, taken, before = flags.limit(0).select("grp", "entity", F.lit(False).alias("by_wide")), None, None
    # What a group may fill up with depends on what earlier ones took, so decisions are repeated until they stay.
    while asked and decided != before:
        before = decided
        wide, whole = contested(flags, points, thing_base, classes, measures, taken, b)
        rows = measures.join(whole, "grp", "left").fillna(0, ["wide", "wide_fraction", "wide_risk", "wide_kept"])
        decided, _ = decide([r.asDict() for r in rows.collect()], links, things, first, b)
        taken = materialize(claimed(decided, wide).select("entity", "grp"), "taken")
    claims_ = claimed(decided, wide)
    decisions = spark.createDataFrame(decided, schema)
    changed = claims_.where(F.col("base_class") != F.col("class_id")).select("entity", "grp", "new")
    # A nested group gives its anchor, as far as it lies in the parent's envelope, to the parent's class.
    up = decisions.where("mode = 'nested'").select("grp", "parent", F.col("label").alias("new"))
    up = up.join(measures.select("grp", "anchor"), "grp").join(measures.select(F.col("grp").alias("parent"), F.col("anchor").alias("pa"), F.col("class_id").alias("pc")), "parent")
    up = up.join(frames.select(F.col("anchor").alias("pa"), "frame"), "pa").join(base.select("entity", F.col("label").alias("anchor"), "base_class"), "anchor").join(points, "entity")
    over = up.where(within("frame", b.nested_margin) & (F.col("base_class") != F.col("pc"))).select("entity", "grp", "new")
    last = materialize(changed.union(over).groupBy("entity").agg(F.max(F.struct("grp", "new")).alias("o")).select("entity", F.col("o.new").alias("new"), F.col("o.grp").alias("grp")), "changes")
    counts = last.groupBy("grp").agg(F.count("*").alias("changed"))
    report = decisions.join(counts, "grp", "left").fillna(0, ["changed"])
    return base.join(last.select("entity", "new"), "entity", "left").select("entity", F.col("label").alias("base"), F.coalesce("new", "label").alias("label")), report
