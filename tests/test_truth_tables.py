"""Small truth tables with known answers, rebuilt as DataFrames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import stats as st
from tallyframe.functions import text as tx
from tallyframe.operators import consensus as cs
from tallyframe.operators import graph, greedy
from tallyframe.operators import labels as lb
from tallyframe.operators import overlap as ov
from tallyframe.operators import spatial as sp
from tallyframe.operators import votes as vt


def dicts(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_observer_collapse(spark):
    rows = [(0, 0, 1, 0.7), (0, 0, 2, 0.3), (0, 1, 1, 0.5), (0, 1, 2, 0.5), (0, 2, 1, 0.2), (0, 2, 2, 0.8)]
    votes = spark.createDataFrame(rows, "observer int, entity long, class_id int, weight double")
    got = dicts(vt.with_unique_winner(votes, vt.OF_VIEW), "entity")
    assert [got[i]["winner"] for i in range(3)] == [1, 0, 2]
    bad = spark.createDataFrame([(0, 0, 1, 0.6), (0, 0, 2, 0.3)], "observer int, entity long, class_id int, weight double")
    assert vt.unit_mass_errors(votes).count() == 0 and vt.unit_mass_errors(bad).count() == 1


COUNTS = {0: (3, 1, 0, 0), 1: (2, 2, 0, 0), 2: (2, 1, 1, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0), 5: (300, 0, 0, 0), 6: (150, 150, 0, 0), 7: (160, 140, 0, 0)}


def stats(spark, counts):
    rows = [(e, c + 1, n) for e, ns in counts.items() for c, n in enumerate(ns) if n]
    entities = spark.createDataFrame([(e,) for e in counts], "entity long")
    return cs.statistics(spark.createDataFrame(rows, "entity long, class_id int, n long"), entities)


def test_consensus_status(spark):
    got = dicts(stats(spark, COUNTS), "entity")
    assert [got[e]["status"] for e in COUNTS] == [cs.ACCEPTED, cs.TIE, cs.NO_MAJORITY, cs.SINGLE, cs.UNOBSERVED, cs.ACCEPTED, cs.TIE, cs.ACCEPTED]
    assert [got[e]["maximum"] for e in (5, 6, 7)] == [300, 150, 160]


def test_leave_one_out(spark):
    table = stats(spark, {0: (3, 1, 0), 1: (2, 1, 0), 2: (2, 2, 0), 3: (1, 1, 1)})
    held = spark.createDataFrame([(9, e, 1) for e in range(4)], "observer int, entity long, winner int")
    got = dicts(cs.leave_one_out(held, table), "entity")
    assert [(got[e]["others"], got[e]["remaining"]) for e in range(4)] == [(1, 3), (0, 2), (2, 3), (0, 2)]


def test_recovery(spark):
    winners = [[1, 1, 1, 1, 1, 0], [1, 2, 0, 1, 1, 0], [1, 2, 0, 2, 1, 0]]
    rows = [(o, e, w, 1.0) for o, ws in enumerate(winners) for e, w in enumerate(ws)]
    w = spark.createDataFrame(rows, "observer int, entity long, winner int, value double")
    s = cs.statistics(cs.winner_counts(w), w)
    rel = cs.reliabilities(cs.leave_one_out(w, s), 1.96)
    assert all(0 <= r["reliability"] <= 1 for r in rel.collect())
    got = dicts(cs.recovered(s, cs.weighted_scores(w, rel)), "entity")
    assert [got[e]["source"] for e in (0, 3, 4)] == [1, 1, 1]
    assert [(got[e]["source"], got[e]["label"]) for e in (2, 5)] == [(0, 0), (0, 0)]
    bad = cs.recovery_violations(cs.labels(s), cs.recovered(s, cs.weighted_scores(w, rel))).first().asDict()
    assert not any(v for k, v in bad.items() if k != "recovered")


def test_joint_and_semantic_winners(spark):
    rows = [(0, 0, 0.6), (0, 1, 0.4), (1, 1, 1.0), (1, 2, 1.0)]
    sums = spark.createDataFrame(rows, "entity long, class_id int, mass double")
    got = dicts(vt.winner_metrics(sums), "entity")
    assert (got[0]["winner"], got[0]["agreement"], got[1]["winner"]) == (0, 0.6, 0)
    columns = {0: (0.60, 0.40, 0.0), 1: (0.35, 0.45, 0.10), 2: (0.0, 1.0, 1.0)}
    sums = spark.createDataFrame([(e, c, m) for e, ms in columns.items() for c, m in enumerate(ms)], "entity long, class_id int, mass double")
    got = dicts(vt.semantic_metrics(sums), "entity")
    assert [got[e]["winner"] for e in range(3)] == [1, 1, 0]
    assert [round(got[e]["evidence"], 6) for e in range(3)] == [0.4, round(0.55 / 0.9, 6), 1.0]
    assert [round(got[e]["agreement"], 6) for e in range(3)] == [1.0, round(0.45 / 0.55, 6), 0.5]


def test_gate_is_inclusive(spark):
    df = spark.createDataFrame([(0.49,), (0.50,), (0.70,)], "e double")
    label = vt.accepted_winner(F.lit(1), F.lit(2), F.lit(0.5), 2, 0.5, F.col("e"), 0.5)
    assert [r[0] for r in df.select(label).collect()] == [0, 1, 1]


def test_weighted_jaccard(spark):
    r = spark.createDataFrame([(1, 0, 0, 1, 1.0), (1, 0, 0, 2, 0.5), (2, 1, 0, 2, 0.5), (2, 1, 0, 3, 1.0), (3, 2, 0, 9, 1.0)], "region long, view int, concept int, entity long, weight double")
    got = ov.similarities(ov.pairs(r), r).collect()
    assert len(got) == 1 and got[0]["jaccard"] == pytest.approx(0.5 / 2.5)


def test_membership(spark):
    votes = spark.createDataFrame([(0, 4, 0.8), (0, 7, 0.2), (1, 4, 0.4), (2, 7, 0.5)], "entity long, region int, weight double")
    got = {r["entity"]: r["region"] for r in vt.dominant(votes, ["entity"], "region", 0.5).collect()}
    assert got == {0: 4, 2: 7}
    tie = spark.createDataFrame([(0, 4, 0.5), (0, 7, 0.5)], "entity long, region int, weight double")
    assert vt.dominant(tie, ["entity"], "region", 0.5).count() == 0
    events = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (0, 1), (2, 1)], "entity long, cluster int")
    seen = spark.createDataFrame([(0, 3), (1, 3), (2, 4), (3, 9)], "entity long, observed long")
    m = dicts(cs.membership(events, seen), "entity")
    assert [(m[e]["support"], m[e]["status"]) for e in range(3)] == [(2, cs.MEMBER), (1, cs.MEMBER_SINGLE), (2, cs.MEMBER_WEAK)]
    one = spark.createDataFrame([(0, 1)], "entity long, cluster int")
    assert cs.membership(one, spark.createDataFrame([(0, 1)], "entity long, observed long")).first()["status"] == cs.MEMBER_SINGLE
    wrong = cs.membership_violations(cs.membership(spark.createDataFrame([(0, 1), (0, 1), (7, 1)], "entity long, cluster int"), spark.createDataFrame([(0, 1)], "entity long, observed long"))).first()
    assert (wrong["unobserved"], wrong["oversupported"]) == (1, 1)


def test_visibility(spark):
    rows = [(0, 0, 0.04), (1, 0, 1.0), (0, 1, 0.004), (1, 1, 0.01), (0, 2, 0.05), (1, 2, 1.0), (0, 3, 0.2), (1, 3, 2.0)]
    seen = spark.createDataFrame(rows, "observer int, entity long, mass double")
    kept = {r["entity"] for r in vt.informative(seen, 0.01, 0.05).where("observer = 0").collect()}
    assert kept == {2, 3}


def test_pooling_by_concept(spark):
    votes = [(0, 1), (0, 1), (0, 2), (0, 2)]
    m = cs.membership(spark.createDataFrame(votes, "entity long, cluster int"), spark.createDataFrame([(0, 6)], "entity long, observed long"), 0.4)
    assert {r["status"] for r in m.collect()} == {cs.MEMBER_WEAK}
    same = spark.createDataFrame([(1, 1), (2, 1)], "cluster int, concept int")
    got = cs.pooled(m, same, 0.4).first()
    assert (got["support"], got["status"]) == (4, cs.MEMBER)


def test_hierarchy(spark):
    def one(*sets):
        rows = [(i + 1, c, e) for i, (c, lo, hi) in enumerate(sets) for e in range(lo, hi)]
        r = spark.createDataFrame([(a, a, c, e, 1.0) for a, c, e in rows], "region long, view int, concept int, entity long, weight double")
        concepts = r.groupBy("region").agg(F.first("concept").alias("concept"), F.count("*").alias("size"))
        return {(x["kind"], x["source"], x["target"]) for x in ov.classified(ov.similarities(ov.pairs(r, False, False), r), concepts).collect()}

    assert one((1, 0, 100), (2, 10, 20), (3, 98, 130)) == {("part_of", 2, 1), ("noise", 1, 3)}
    assert one((3, 0, 10), (3, 0, 9)) == {("merge", 2, 1)}
    assert one((3, 0, 100), (3, 10, 20)) == {("noise", 1, 2)}


def test_geometry(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "entity long, x double, y double, z double")
    support = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0)], "cluster int, entity long, weight double")
    got = ov.geometry(support, points, "cluster").first()
    assert (got["cx"], got["min_x"], got["max_x"]) == (1.5, 0.0, 2.0)


def test_replacement(spark):
    base = spark.createDataFrame([(0, 15, 4, 1), (1, 0, 4, 3), (2, 9, 4, 1)], "entity long, label int, visible long, incumbent_wins long")
    evidence = spark.createDataFrame([(0, 151, 3, 3, 2.4), (1, 151, 1, 1, 0.7), (2, 151, 2, 2, 1.6)], "entity long, class_id int, wins long, positive long, mass double")
    got = dicts(cs.replacements(base, evidence, [151]), "entity")
    assert [got[e]["label"] for e in range(3)] == [151, 0, 151]


def test_smallest_class_on_a_tie(spark):
    votes = spark.createDataFrame([(0, 2, 0.4), (0, 1, 0.4)], "entity long, class_id int, weight double")
    assert vt.smallest_winner(votes, ["entity"]).first()["winner"] == 1


def test_override_merge(spark):
    base = spark.createDataFrame(list(enumerate([0, 1, 1, 2, 0, 2])), "entity long, label int")
    ext = spark.createDataFrame(list(enumerate([0, 3, 0, 4, 4, 0])), "entity long, extension int")

    def merged(ids):
        got = dicts(lb.merged(base, ext, spark.createDataFrame(ids, "extension int, new int, place int")), "entity")
        return [got[e]["label"] for e in range(6)]

    assert merged([(3, 3, 1)]) == [0, 3, 1, 2, 0, 2]
    assert merged([(4, 3, 1), (3, 4, 2)]) == [0, 4, 1, 3, 3, 2]


def line(spark, xs):
    return spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(xs)], "entity long, x double, y double, z double")


def test_voxel_components(spark):
    groups = lambda xs, size: len({r["component"] for r in sp.voxel_components(line(spark, xs), size).collect()})
    assert groups([0.0, 0.02, 0.11, 0.13], 0.1) == 1
    assert groups([0.0, 0.02, 1.0, 1.02], 0.1) == 2
    assert groups([0.0, 0.01, 0.02, 1.0, 1.01, 1.02], 0.1) == 2


def test_radius_and_voxel_components_equal_brute_force(spark):
    rng = random.Random(7)
    pts = [(i, rng.random(), rng.random(), rng.random()) for i in range(150)]
    df = spark.createDataFrame(pts, "entity long, x double, y double, z double")

    def brute(near):
        root = list(range(len(pts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(pts)):
            for j in range(i):
                if near(pts[i][1:], pts[j][1:]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(pts))]

    got = {r["entity"]: r["component"] for r in sp.radius_components(df, 0.13).collect()}
    assert [got[i] for i in range(150)] == brute(lambda p, q: math.dist(p, q) <= 0.13)
    got = {r["entity"]: r["component"] for r in sp.voxel_components(df, 0.09).collect()}
    cell = lambda p: [math.floor(x / 0.09) for x in p]
    assert [got[i] for i in range(150)] == brute(lambda p, q: all(abs(a - b) <= 1 for a, b in zip(cell(p), cell(q))))


def test_adaptive_thresholds(spark):
    df = spark.createDataFrame([(43, False)], "views int, thing boolean")
    got = df.select(lb.adaptive_minimum(F.col("views"), 50, 0, F.col("thing"), 0, 10000, 0.5, 0.5)).first()[0]
    assert 5000 <= got <= 10000


PROMPTS = {"piano": ["piano"], "guitar": ["guitar", "acoustic guitar"], "floor": ["floor"], "speaker": ["speaker", "floor speaker"], "table": ["table", "desk"]}


def test_phrases(spark):
    prompts = spark.createDataFrame([(c, p) for c, ps in PROMPTS.items() for p in ps], "class string, prompt string")
    asked = {"acoustic": "guitar", "floor speaker": "speaker", "piano on floor": "unknown", "Desk!": "table", "": "unknown", "x": "unknown"}
    got = {r["phrase"]: r["class"] for r in tx.resolved_phrases(spark.createDataFrame([(p,) for p in asked], "phrase string"), prompts).collect()}
    assert got == asked


def test_name_rules(spark):
    df = spark.createDataFrame([("  Window-Shutter  big ",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(tx.class_key(F.col("s")), tx.class_key(F.col("s"), None), tx.spaced_key(F.col("s")), tx.words(F.col("s"), "_")).collect()]
    assert got == [("window_shutter_big", "window_shutter_big", "window-shutter__big", "window_shutter_big"), ("unknown", "", "unknown", ""), ("unknown", "", "unknown", "")]


def poses(spark, xs, covered=None):
    return spark.createDataFrame([(i, float(x), 0.0, 0.0, 0.0, float((covered or {}).get(i, 0.0))) for i, x in enumerate(xs)], "observer long, px double, py double, pz double, yaw double, covered double")


def test_camera_selection(spark):
    assert [r["observer"] for r in greedy.farthest(poses(spark, [0, 1, 2, 10]), [0], 2, 1.0).collect()] == [3, 2]
    chosen = {r["observer"] for r in greedy.low_coverage(poses(spark, [0, 1, 2, 3], {0: 1.0, 1: 0.2, 2: 0.25, 3: 0.9}), [0], 2, 0.67, 0.8, 0.2, 1.0).collect()}
    assert chosen == {1, 2}
    novel = [r["observer"] for r in greedy.low_coverage(poses(spark, [0, 0.1, 4], {0: 1.0, 1: 0.5, 2: 0.5}), [0], 1, 1.0, 0.0, 1.0, 1.0).collect()]
    assert novel == [2]


def test_evenly_spaced_positions(spark):
    got = spark.range(4).select(F.rint(F.col("id") * 9 / 3).cast("int")).collect()
    assert [r[0] for r in got] == [0, 3, 6, 9]


def test_cannot_links(spark):
    sets = {1: (0, {0, 1}), 2: (1, {0, 1, 2, 3}), 3: (0, {2, 3})}
    r = spark.createDataFrame([(i, v, 0, e, 1.0) for i, (v, es) in sets.items() for e in es], "region long, view int, concept int, entity long, weight double")
    sim = ov.similarities(ov.pairs(r), r).select(F.lit(0).alias("concept"), "a", "b", "shared", "jaccard")
    free = spark.createDataFrame([], "concept int, a long, b long")
    banned = spark.createDataFrame([(0, 1, 3)], "concept int, a long, b long")
    groups = lambda f: len({x["cluster"] for x in greedy.constrained_clusters(sim, f, 0.3).collect()})
    assert (groups(free), groups(banned)) == (1, 2)


def test_unconstrained_association_equals_brute_force(spark):
    rng = random.Random(7)
    masks = [(v, {rng.randrange(200): rng.random() + 0.1 for _ in range(rng.randrange(3, 30))}) for v in range(6) for _ in range(4)]
    r = spark.createDataFrame([(i, v, 0, e, w) for i, (v, m) in enumerate(masks) for e, w in m.items()], "region long, view int, concept int, entity long, weight double")
    got = {x["region"]: x["cluster"] for x in ov.clusters(r, ov.similarities(ov.pairs(r), r), 0.08).collect()}
    root = list(range(len(masks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (v, a) in enumerate(masks):
        for j in range(i):
            u, b = masks[j]
            low = sum(min(a[e], b[e]) for e in a.keys() & b.keys())
            if u != v and low / (sum(a.values()) + sum(b.values()) - low) >= 0.08:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert [got[i] for i in range(len(masks))] == [find(i) for i in range(len(masks))]


def test_suppression(spark):
    boxes = [(0, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 2, 0.8, 1.0, 1.0, 11.0, 11.0), (0, 1, 3, 0.7, 20.0, 20.0, 30.0, 30.0), (0, 2, 4, 0.6, 0.0, 0.0, 10.0, 10.0), (0, 1, 5, 0.99, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "frame int, class_id int, box long, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r["box"] for r in greedy.suppressed(df, 4.0, 500.0, 0.5, 10).collect()} == {1, 3, 4}


def test_sequential_clusters(spark):
    rows = [(0, 1, 0.9, [1, 2, 3, 4]), (0, 2, 0.8, [3, 4]), (0, 3, 0.7, [9]), (1, 4, 0.6, [1, 2])]
    df = spark.createDataFrame(rows, "concept int, region long, score double, entities array<long>")
    got = {r["region"]: r["cluster"] for r in greedy.sequential_clusters(df, 0.5, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", True, 9, 5), ("b", True, 8, 4), ("c", False, 99, 2)], "item string, thing boolean, size int, words int")
    assert {r["item"]: r["kept"] for r in greedy.within_budget(df, 7).collect()} == {"a": True, "b": False, "c": True}


def test_radius_components_of_dense_and_sparse_points(spark):
    """Clumps, chains and stray points; 20,000 points in one clump cost no pairs."""
    rng = random.Random(17)
    blob = lambda n, at, width: [[c + rng.uniform(-width, width) for c in at] for _ in range(n)]
    spots = blob(60, (0, 0, 0), 0.2) + blob(40, (0.9, 0, 0), 0.3) + blob(60, (3, 3, 3), 1.2) + [[0.5 + 0.24 * k, 5.0, -2.0] for k in range(12)] + [[0.0, 0.0, 0.0]] * 3
    for radius in (0.12, 0.6):
        root = list(range(len(spots)))
        for i in range(len(spots)):
            for j in range(i):
                if math.dist(spots[i], spots[j]) <= radius:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(9999, None, 1.0, 1.0)], "entity long, x double, y double, z double")
        got = {r["entity"]: r["component"] for r in sp.radius_components(df, radius).collect()}
        assert got.pop(9999) == 9999 and [got[i] for i in range(len(spots))] == root
    dense = spark.range(20000).select(F.col("id").alias("entity"), *((F.rand(k) * 0.4).alias(c) for k, c in enumerate("xyz")))
    assert {r["component"] for r in sp.radius_components(dense, 0.3).collect()} == {0}


def test_cycles_and_terminals(spark):
    edges = lambda e: spark.createDataFrame(e, "child long, parent long")
    assert graph.cycles(edges([(1, 2), (2, 3), (4, 2)])).count() == 0
    assert {tuple(r) for r in graph.cycles(edges([(1, 2), (2, 3), (3, 1), (9, 1)])).select("child", "parent").collect()} >= {(1, 2), (2, 3), (3, 1)}
    got = dict(graph.terminals(spark.createDataFrame([(5, 4), (4, 3), (3, 1), (8, 7)], "source long, target long")).collect())
    assert got == {5: 1, 4: 1, 3: 1, 8: 7}


def test_box_functions(spark):
    one = spark.range(1)
    box = lambda *v: [F.lit(float(x)) for x in v]
    iou = one.select(st.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), st.box_iou(box(0, 0, 1, 1), box(5, 5, 6, 6))).first()
    assert iou[0] == pytest.approx(1 / 3) and iou[1] == 0
    assert one.select(st.pixel_intersection([F.lit(x) for x in (0, 0, 2, 2)], [F.lit(x) for x in (2, 2, 4, 4)])).first()[0] == 1
    w, h = st.scaled(F.lit(1000), F.lit(501), 500)
    assert tuple(one.select(w, h).first()) == (500, 250)


def test_principal_extents(spark):
    rng = random.Random(1)
    pts = [(i, 1, 10 * rng.random(), 2 * rng.random(), 0.1 * rng.random()) for i in range(400)]
    df = spark.createDataFrame(pts, "entity long, grp int, x double, y double, z double")
    r = sp.robust_extents(df, "grp").first()
    assert r["e1"] > 7 and 1 < r["e2"] < 2.2 and r["e3"] < 0.2


def refinement(spark, **change):
    """A chair (label 1, class 1) of 100 points, a table (label 2, class 2), and groups over them."""
    from tallyframe.operators import refine

    rng = random.Random(3)
    points, base, sources, claims = [], [], [], []

    def blob(first, n, x, label, cls):
        for i in range(first, first + n):
            points.append((i, x + rng.random(), rng.random(), rng.random()))
            base.append((i, label, cls))

    blob(0, 100, 0.0, 1, 1)  # the chair
    blob(100, 40, 0.9, 0, 0)  # unlabelled points beside it
    blob(200, 100, 10.0, 2, 2)  # the table
    blob(400, 80, 20.0, 0, 0)  # another chair, without an anchor
    groups = {1: (1, [*range(0, 140)], 3, 4), 2: (2, [*range(0, 30)], 3, 4), 3: (1, [*range(400, 480)], 6, 6), 4: (2, [*range(200, 300)], 1, 1)}
    for g, (cls, entities, _, _) in groups.items():
        sources += [(g, cls, e) for e in entities]
    claims = [(1, e) for e in [*range(0, 140), *range(400, 480)]] + [(2, e) for e in range(200, 300)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return refine.refined(
        frame(sources, "grp int, class_id int, entity long"),
        frame(claims, "class_id int, entity long"),
        frame(base, "entity long, label int, base_class int"),
        frame(points, "entity long, x double, y double, z double"),
        frame([(g, p, v) for g, (_, _, p, v) in groups.items()], "grp int, proposals int, views int"),
        {1, 2},
        refine.Bounds(min_anchor=20, voxel=0.6, envelope_margin=1.0, prototype_size=6.0, prototype_shape=6.0, **change),
    )


def test_guarded_refinement(spark):
    out, report = refinement(spark)
    got = dicts(report, "grp")
    assert [got[g]["mode"] for g in (1, 2, 3, 4)] == ["anchor", "rejected", "prototype", "rejected"]
    assert got[2]["reason"] == "anchor_overlap" and got[4]["reason"] == "support"
    labels = {r["entity"]: r["label"] for r in out.collect()}
    # The chair keeps its label, its neighbours and the second chair get the groups' new ones.
    assert all(labels[e] == 1 for e in range(100)) and all(labels[e] == 2 for e in range(200, 300))
    assert {labels[e] for e in range(400, 480)} == {got[3]["label"]} and got[3]["changed"] == 80
    assert got[1]["changed"] > 20 and got[1]["changed"] == sum(labels[e] == got[1]["label"] for e in range(100, 140))


def test_recovery_of_a_contested_object(spark):
    """A second chair that the base calls a sofa and that sofas claim, too: the first chair's shape gives it back."""
    from tallyframe.operators import refine

    rng = random.Random(4)
    place = {**{i: 0.0 for i in range(100)}, **{i: 20.0 for i in range(400, 500)}}
    points = [(i, x + rng.random(), rng.random(), rng.random()) for i, x in place.items()]
    base = [(i, 1 if i < 100 else 3, 1 if i < 100 else 3) for i in place]
    sources = [(1 if i < 100 else 2, 1, i) for i in place]
    # Of the second chair only ten entities are claimed by chairs alone.
    claims = [(1, i) for i in place] + [(3, i) for i in range(410, 500)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)

    def run(views, **change):
        out, report = refine.refined(
            frame(sources, "grp int, class_id int, entity long"),
            frame(claims, "class_id int, entity long"),
            frame(base, "entity long, label int, base_class int"),
            frame(points, "entity long, x double, y double, z double"),
            frame([(1, 3, 4), (2, 6, views)], "grp int, proposals int, views int"),
            {1, 3},
            refine.Bounds(min_anchor=20, voxel=0.6, **change),
        )
        return dicts(report, "grp"), {r["entity"]: r["label"] for r in out.collect()}

    got, labels = run(6)
    assert [got[g]["mode"] for g in (1, 2)] == ["anchor", "recovered"] and got[2]["changed"] == 100
    assert {labels[i] for i in range(400, 500)} == {got[2]["label"]} and all(labels[i] == 1 for i in range(100))
    # Too few views, or too little of one competing object below: it stays as it was.
    for got, labels in (run(4), run(6, prototype_ambiguous=1.01)):
        assert got[2]["mode"] == "rejected" and all(labels[i] == 3 for i in range(400, 500))


def test_refinement_without_prototypes(spark):
    got = dicts(refinement(spark, prototype_views=99, prototype_strong_views=99)[1], "grp")
    assert got[3]["mode"] == "rejected" and got[3]["changed"] == 0


def test_takeover_is_sequential(spark):
    sets = {1: (0.1, [1, 2, 3, 4]), 2: (0.2, [3, 4, 5]), 3: (0.3, [5, 6, 7]), 4: (0.9, [8, 9, 10]), 5: (0.4, [3, 4, 5, 11])}
    c = spark.createDataFrame([(k, r, len(e)) for k, (r, e) in sets.items()], "candidate int, risk double, size int")
    s = spark.createDataFrame([(k, x) for k, (_, e) in sets.items() for x in e], "candidate int, entity long")
    got = {r["candidate"]: (r["reason"], r["taken"]) for r in greedy.takeover(c, s, 0.5, 2).collect()}
    assert got == {1: ("accepted", 4), 2: ("small", 0), 3: ("accepted", 3), 4: ("risk", 0), 5: ("small", 0)}
