"""Order-dependent selection: each group's decisions are taken in sequence.

The order is total and stated, so results don't depend on partitions. Inputs are
edges or candidates of one concept, class or frame, not the entities below them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def contracted(edges, apart) -> dict:
    """Node -> least node of its cluster, once ``edges`` are contracted in order.

    ``apart`` lists pairs that must not end up together. It is a graph over the
    same nodes and is contracted with them: a cluster has the neighbours of all its
    members, so whether two clusters may join is one lookup.
    """
    rivals, cluster, members = defaultdict(set), {}, {}
    for a, b in apart:
        rivals[a].add(b)
        rivals[b].add(a)
    for a, b in edges:
        kept, gone = sorted((cluster.setdefault(a, a), cluster.setdefault(b, b)))
        if kept == gone or gone in rivals[kept]:
            continue
        moved = members.pop(gone, [gone])
        members.setdefault(kept, [kept]).extend(moved)
        cluster.update(dict.fromkeys(moved, kept))
        for rival in rivals.pop(gone, ()):
            rivals[rival].discard(gone)
            rivals[rival].add(kept)
            rivals[kept].add(rival)
    return cluster


def constrained_clusters(edges: DataFrame, forbidden: DataFrame, threshold: float) -> DataFrame:
    """(concept, region, cluster): edges (concept, a, b, shared, jaccard) at ``threshold`` or above are contracted by
    falling overlap, then ids; two clusters join unless a forbidden pair would end up in one.

    A task holds the strong edges of a concept and the forbidden pairs among their ends; regions without a strong
    edge never reach one.
    """
    regions = edges.select("concept", F.explode(F.array("a", "b")).alias("region")).distinct()
    strong = materialize(edges.where(F.col("jaccard") >= threshold), "strong")
    ends = strong.select("concept", F.explode(F.array("a", "b")).alias("a")).distinct()
    against = forbidden.join(ends, ["concept", "a"], "left_semi").join(ends.withColumnRenamed("a", "b"), ["concept", "b"], "left_semi")

    def run(key, mine: pd.DataFrame, rivals: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["shared", "a", "b"], ascending=[False, True, True])
        cluster = contracted(zip(mine["a"], mine["b"], strict=True), zip(rivals["a"], rivals["b"], strict=True))
        return pd.DataFrame({"concept": [key[0]] * len(cluster), "region": list(cluster), "cluster": list(cluster.values())})

    joined = strong.groupBy("concept").cogroup(against.groupBy("concept")).applyInPandas(run, "concept int, region long, cluster long")
    return regions.join(joined, ["concept", "region"], "left").select("concept", "region", F.coalesce("cluster", "region").alias("cluster"))


def disjoint_components(edges: DataFrame) -> DataFrame:
    """(region, cluster): edges (part, a, b, va, vb, score) by falling score; clusters join if no view is in both."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        root, views = {}, {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for e in mine.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
            views.setdefault(e.a, {e.va})
            views.setdefault(e.b, {e.vb})
            a, b = find(e.a), find(e.b)
            if a != b and not views[a] & views[b]:
                low, high = min(a, b), max(a, b)
                root[high] = low
                views[low] |= views[high]
        nodes = sorted(root)
        return pd.DataFrame({"region": nodes, "cluster": [find(n) for n in nodes]})

    return edges.groupBy("part").applyInPandas(run, "region long, cluster long")


def strongest(shared: dict[int, int], size: int, sizes: list[int]) -> tuple[int | None, float, float]:
    """(group, overlap, containment): groups are met in order, and each that beats the strongest so far in either measure replaces it."""
    found, overlap, inside = None, 0.0, 0.0
    for g in sorted(shared):
        measures = shared[g] / (size + sizes[g] - shared[g]), shared[g] / min(size, sizes[g])
        if measures[0] > overlap or measures[1] > inside:
            found, (overlap, inside) = g, measures
    return found, overlap, inside


def sequential_clusters(regions: DataFrame, merge_iou: float, containment: float) -> DataFrame:
    """(concept, region, cluster): regions (concept, region, score, entities) by falling score and size join the
    strongest group, if its overlap or containment reaches its bound, else open one of their own.

    Only groups that hold one of a region's entities can be strongest, so an index from entities to groups is all
    that is looked at: a region costs its entities, whatever the number of groups. A task holds a concept's index.
    """

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.assign(n=mine["entities"].map(len)).sort_values(["score", "n", "region"], ascending=[False, False, True])
        groups_of, names, sizes, out = defaultdict(set), [], [], []
        for concept, region, entities in zip(mine["concept"], mine["region"], mine["entities"], strict=True):
            own = set(entities)
            shared = Counter(g for e in own for g in groups_of.get(e, ()))
            group, overlap, inside = strongest(shared, len(own), sizes)
            if group is None or (overlap < merge_iou and inside < containment):
                group = len(names)
                names.append(region)
                sizes.append(0)
            for e in own:
                sizes[group] += group not in groups_of[e]
                groups_of[e].add(group)
            out.append((concept, region, names[group]))
        return pd.DataFrame(out, columns=["concept", "region", "cluster"])

    return regions.groupBy("concept").applyInPandas(run, "concept int, region long, cluster long")


def first_come(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, node) that stay if nodes (part, node, place) are taken in order of place and each that has an edge
    (part, a, b) to a taken one is left out. A task holds the edges of a part."""

    def run(key, mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        beside = defaultdict(list)
        for a, b in zip(near["a"], near["b"], strict=True):
            beside[a].append(b)
            beside[b].append(a)
        out, kept = set(), []
        for node in mine.sort_values("place")["node"]:
            if node not in out:
                kept.append(node)
                out.update(beside[node])
        return pd.DataFrame({"part": [key[0]] * len(kept), "node": kept})

    nodes, edges = materialize(nodes.select("part", "node", "place"), "nodes"), materialize(edges, "edges")
    return nodes.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(run, "part int, node long")


def box_overlap(p, q) -> float:
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)


def suppressed(boxes: DataFrame, min_area: float, max_area: float, max_iou: float, limit: int) -> DataFrame:
    """Greedy suppression per (frame, class_id): boxes by falling score, dropped if they overlap a kept one too much."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for r in mine.sort_values(["score", "box"], ascending=[False, True]).itertuples():
            area, box = (r.x1 - r.x0) * (r.y1 - r.y0), (r.x0, r.y0, r.x1, r.y1)
            if min_area <= area <= max_area and len(kept) < limit and all(box_overlap(box, k[1]) < max_iou for k in kept):
                kept.append((r, box))
        return pd.DataFrame([(r.frame, r.class_id, r.box, i + 1) for i, (r, _) in enumerate(kept)], columns=["frame", "class_id", "box", "place"])

    return boxes.groupBy("frame", "class_id").applyInPandas(run, "frame int, class_id int, box long, place int")


def _one_group(poses: DataFrame, run, schema: str) -> DataFrame:
    """Cameras of a scene are some hundreds: one group holds them."""
    return poses.groupBy(F.lit("all")).applyInPandas(run, schema)


def pose_distance(p, q, scale: float, weight: float) -> float:
    d = math.dist(p[:3], q[:3]) / scale
    turn = abs((p[3] - q[3] + math.pi) % (2 * math.pi) - math.pi)
    return math.hypot(d, weight * turn / math.pi)


def farthest(poses: DataFrame, start: list[int], count: int, scale: float, weight: float = 1.0) -> DataFrame:
    """(observer, place): cameras picked one by one, each the farthest from all picked; smaller id on ties."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        at = {int(r.observer): (r.px, r.py, r.pz, r.yaw) for r in mine.sort_values("observer").itertuples()}
        picked, out = [i for i in start if i in at], []
        gap = {i: min((pose_distance(p, at[j], scale, weight) for j in picked), default=math.inf) for i, p in at.items() if i not in picked}
        while gap and len(out) < count:
            best = max(gap, key=lambda i: (round(gap[i], 9), -i))
            out.append(best)
            del gap[best]
            for i in gap:
                gap[i] = min(gap[i], pose_distance(at[i], at[best], scale, weight))
        return pd.DataFrame({"observer": out, "place": range(1, len(out) + 1)})

    return _one_group(poses, run, "observer long, place int")


def low_coverage(poses: DataFrame, start: list[int], count: int, quantile: float, need_weight: float, novelty_weight: float, scale: float) -> DataFrame:
    """(observer, place): among cameras (with ``covered``) at or below the coverage quantile, topped up to ``count``,
    the best of need and novelty, both scaled to [0, 1] at every step."""

    def scaled(values):
        low, high = min(values.values()), max(values.values())
        return {k: 1.0 if high - low < 1e-12 else (v - low) / (high - low) for k, v in values.items()}

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("observer")
        at = {int(r.observer): (r.px, r.py, r.pz, r.yaw) for r in mine.itertuples()}
        covered = {int(r.observer): r.covered for r in mine.itertuples() if int(r.observer) not in start}
        bound = pd.Series(list(covered.values())).quantile(quantile)
        order = sorted(covered, key=lambda i: (covered[i], i))
        open_ = [i for i in order if covered[i] <= bound]
        open_ += [i for i in order if i not in open_][: max(0, count - len(open_))]
        picked, out = [i for i in start if i in at], []
        while open_ and len(out) < count:
            need = scaled({i: 1 - covered[i] for i in open_})
            novelty = scaled({i: min((pose_distance(at[i], at[j], scale, 1.0) for j in picked), default=1.0) for i in open_})
            best = max(open_, key=lambda i: (round(need_weight * need[i] + novelty_weight * novelty[i], 9), -i))
            out.append(best)
            picked.append(best)
            open_.remove(best)
        return pd.DataFrame({"observer": out, "place": range(1, len(out) + 1)})

    return _one_group(poses, run, "observer long, place int")


def separated(poses: DataFrame, source: int, target: tuple, min_source: float, min_pair: float, count: int) -> DataFrame:
    """(observer, place): cameras in order whose rays to the target differ enough from the source's and all picked."""

    def angle(p, q):
        n = math.dist(p, (0, 0, 0)) * math.dist(q, (0, 0, 0))
        return 0.0 if n < 1e-12 else math.degrees(math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(p, q, strict=True)) / n))))

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        ray = {int(r.observer): tuple(t - c for t, c in zip(target, (r.px, r.py, r.pz), strict=True)) for r in mine.sort_values("observer").itertuples()}
        out = []
        for i, r in ray.items():
            if i != source and len(out) < count and angle(r, ray[source]) >= min_source and all(angle(r, ray[j]) >= min_pair for j in out):
                out.append(i)
        return pd.DataFrame({"observer": out, "place": range(1, len(out) + 1)})

    return _one_group(poses, run, "observer long, place int")


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """(item, kept): items (item, thing, size, words) things first, larger first; kept while their words fit, others skipped."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in mine.sort_values(["thing", "size", "item"], ascending=[False, False, True]).itertuples():
            fits = used + r.words <= budget
            used += r.words if fits else 0
            out.append((r.item, bool(fits)))
        return pd.DataFrame(out, columns=["item", "kept"])

    return _one_group(items, run, "item string, kept boolean")


def takeover(candidates: DataFrame, support: DataFrame, max_risk: float, min_size: int) -> DataFrame:
    """(candidate, accepted, reason, taken): candidates (candidate, risk, size) by rising risk, falling size and id
    take the entities of ``support`` (candidate, entity) that no accepted earlier one took; those left with too few go.

    What a candidate gets depends on earlier ones only, so the earliest that falls short is final. So are those
    after it that fall short even if they got all that the final ones leave. Each round drops both, by an aggregate
    over entities; decisions stay in tables.
    """
    order = Window.orderBy("risk", F.desc("size"), "candidate")  # candidates are a dimension
    ranked = materialize(candidates.withColumn("place", F.row_number().over(order)), "ranked")
    alive = ranked.where(F.col("risk") <= max_risk).select("candidate", "place")
    while True:
        claims = support.join(alive, "candidate").select("entity", "candidate", "place")
        first = claims.groupBy("entity").agg(F.min(F.struct("place", "candidate")).alias("o"))
        taken = first.groupBy(F.col("o.candidate").alias("candidate")).agg(F.count("*").alias("taken"))
        counts = materialize(alive.join(taken, "candidate", "left").fillna(0, ["taken"]), "taken")
        short = counts.where(F.col("taken") < min_size).agg(F.min("place")).first()[0]
        if short is None:
            break
        left = claims.join(first.select("entity", F.col("o.place").alias("by")), "entity").where(F.col("by") >= short)
        bound = left.where(F.col("place") > short).groupBy("candidate").agg(F.count("*").alias("most"))
        rest = counts.join(bound, "candidate", "left").where((F.col("place") < short) | ((F.col("place") > short) & (F.coalesce("most", F.lit(0)) >= min_size)))
        alive = materialize(rest.select("candidate", "place"), "alive")
    reason = F.when(F.col("taken").isNotNull(), "accepted").when(F.col("risk") > max_risk, "risk").otherwise("small")
    return ranked.join(counts.select("candidate", "taken"), "candidate", "left").select(
        "candidate", F.col("taken").isNotNull().alias("accepted"), reason.alias("reason"), F.coalesce("taken", F.lit(0)).alias("taken")
    )
