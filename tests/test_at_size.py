"""Queries whose work or rows used to grow faster than their tables: brute force on small tables, and what their plans make."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyframe.operators import graph, overlap, spatial
from tallyframe.plans import registry
from tallyframe.plans import spatial as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_row_for_each_pair(df):
    return not any(word in plan(df) for word in ("CartesianProduct", "NestedLoopJoin"))


POINTS = "entity long, x double, y double, z double"


def test_view_statistics(spark, monkeypatch):
    monkeypatch.setattr(spatial, "VIEW_PAIRS", 300)
    rng = random.Random(5)
    points = [(k, *(rng.uniform(-3, 3) for _ in "xyz")) for k in range(101)]
    points += [(101, None, 0.0, 1.0), (102, 0.5, None, 1.0), (103, float("nan"), 0.0, 0.0)]
    cameras = [(k, *(rng.uniform(-4, 4) for _ in range(3)), rng.uniform(0, 7)) for k in range(20)]
    cameras += [(3, 0.0, 0.0, 0.0, 1.0), (20, None, 0.0, 0.0, 0.0), (21, 0.0, None, 0.0, 0.0)]
    found = spatial.view_statistics(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(cameras, "observer long, px double, py double, pz double, yaw double"), 200.0, 640.0, 480.0, 0.25
    )
    got = {r["observer"]: (r["front"], r["inside"], r["depth"]) for r in found.collect()}
    want = {}
    for observer in range(22):
        depths, inside, pairs = [], 0, 0
        for _, px, py, pz, yaw in (c for c in cameras if c[0] == observer):
            for _, x, y, z in points:
                pairs += 1
                if px is None or x is None:
                    continue
                dx, dz = x - px, z - pz
                depth = math.cos(yaw) * dz + math.sin(yaw) * dx
                depths.append(depth)
                if depth > 1e-6 and y is not None and py is not None:
                    u, v = 320 + 200 * (math.cos(yaw) * dx - math.sin(yaw) * dz) / depth, 240 + 200 * (y - py) / depth
                    inside += 0 <= u < 640 and 0 <= v < 480
        front = sum(x > 1e-6 or math.isnan(x) for x in depths) / len(depths) if depths else None
        want[observer] = (front, inside / pairs, np.quantile([math.inf if math.isnan(x) else x for x in depths], 0.25) if depths else None)
    assert got.keys() == want.keys()
    for observer, (front, inside, depth) in want.items():
        assert got[observer][:2] == (front, inside)
        assert got[observer][2] == (depth if depth is None else pytest.approx(depth, abs=1e-12))
    assert any(w[1] > 0 for w in want.values())


def test_projection_rejections_make_no_row_for_each_pair(spark, sf_dir):
    assert no_row_for_each_pair(plans._metrics(spark, sf_dir))
    assert "/views" in plan(registry.load()["projection_rejections"][0](spark, sf_dir))


def test_view_prompts_rank_views_before_their_boxes(spark, sf_dir):
    assert "/top" in plan(registry.load()["view_prompts"][0](spark, sf_dir))


def test_projection_metrics_make_no_row_for_each_pair(spark, sf_dir):
    assert no_row_for_each_pair(registry.load()["projection_metrics"][0](spark, sf_dir))


def test_points_are_copied_for_parts_of_the_cameras_beyond_a_bound_only(spark, monkeypatch):
    monkeypatch.setattr(spatial, "VIEW_PAIRS", 2000)
    rng = random.Random(8)
    points = [(k, *(rng.uniform(-3, 3) for _ in "xyz")) for k in range(150)] + [(150, None, 0.0, 1.0), (151, 0.5, None, 1.0), (152, math.nan, 0.0, 0.0)]
    cameras = [(k % 25, *(rng.uniform(-4, 4) for _ in range(3)), rng.uniform(0, 7)) for k in range(30)] + [(40, None, 0.0, 0.0, 0.0), (41, 0.0, 0.0, 0.0, math.inf)]
    p, c = spark.createDataFrame(points, POINTS), spark.createDataFrame(cameras, "observer long, px double, py double, pz double, yaw double")
    seen = lambda p, c: spatial.view_statistics(p, c, 200.0, 640.0, 480.0, 0.25)
    rows = lambda df: sorted(map(str, df.collect()))
    assert "CoGroup" not in plan(seen(p, c)) and not rows(seen(p.limit(0), c)) and not rows(seen(p, c.limit(0)))
    few = rows(seen(p, c))
    monkeypatch.setattr(spatial, "VIEW_POINTS", 100)
    assert "CoGroup" in plan(seen(p, c)) and rows(seen(p, c)) == few and len(few) == 27


def test_neighbour_distance(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 16)
    rng = random.Random(6)
    points = [(k, *(rng.gauss(0, 1) for _ in "xyz")) for k in range(150)]
    points += [(150 + k, *(1 + rng.uniform(0, 1e-6) for _ in "xyz")) for k in range(60)]
    points += [(300 + k, 0.5, -0.0 if k % 2 else 0.0, 0.5) for k in range(40)] + [(400 + k, 2.0, 2.0, 2.0 + k / 8) for k in range(3)]
    points += [(5, 9.0, 9.0, 9.0), (5, 9.0, 9.0, 9.0), (350, 9.0, 9.0, 9.1), (351, 9.0, 9.0, 9.2), (500, 1e9, 0.0, 0.0)]
    points += [(501, None, 0.0, 0.0), (502, float("nan"), 0.0, 0.0), (503, float("inf"), 0.0, 0.0), (None, 0.5, 0.0, 0.5)]
    found = spatial.neighbour_distance(spark.createDataFrame(points, POINTS), 3, 0.7)
    got = {r["entity"]: r["distance"] for r in found.collect()}
    near = {}
    for e, *p in points:
        for o, *q in points:
            if None not in (e, o, *p, *q) and e != o:
                dx, dy, dz = (a - b for a, b in zip(p, q, strict=True))
                square = dx * dx + dy * dy + dz * dz
                if square <= 0.7 * 0.7:
                    near.setdefault(e, []).append(math.sqrt(square))
    want = {e: sorted(v)[2] for e, v in near.items() if len(v) >= 3}
    assert got.keys() == want.keys()
    assert got == want and 150 < len(want) < len({p[0] for p in points})


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + k * 7 % 60, 1000 + (k + 1) * 7 % 60) for k in range(59)]
    edges += [(2000, k) for k in range(1950, 2050)] + [(None, 3), (4, None), (-5, -5), (-7, 2000)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u in root and v in root and u != v:
                root[u] = root[v] = min(root[u], root[v])
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or write(df, name))
    for kind in ("long", "int"):
        got = graph.components(spark.createDataFrame(edges, f"u {kind}, v {kind}"))
        assert dict(got.collect()) == root and {t for _, t in got.dtypes} == {"bigint" if kind == "long" else kind}
    assert written == ["edges", "roots"] * 2
    monkeypatch.setattr(graph, "FEW", 0)
    assert dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect()) == root and len(written) > 8


def test_hilbert_order_steps_to_the_next_cell():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)], dtype=np.uint64)
    keys = [row.tobytes() for row in spatial._hilbert(cells, 3)]
    walk = cells[sorted(range(512), key=keys.__getitem__)].astype(int)
    assert len(set(keys)) == 512 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_local_spacing_visits_near_leaves_only(spark, sf_dir):
    assert "/leaves" in plan(registry.load()["local_spacing"][0](spark, sf_dir))


def test_contained_and_alike_regions(spark, monkeypatch):
    """In rounds, with an entity that all regions share, copies, and regions inside larger ones."""
    monkeypatch.setattr(overlap, "ROUND_PAIRS", 2000)
    monkeypatch.setattr(overlap, "HITS", 2)
    rng = random.Random(7)
    sets = {r: {0, *rng.sample(range(1, 80), rng.randrange(1, 40))} for r in range(60)}
    for r in range(60, 90):
        own = sorted(sets[rng.randrange(60)])
        sets[r] = {*rng.sample(own, max(1, round(len(own) * rng.choice([0.5, 1])))), *rng.sample(range(100, 300), rng.randrange(4))}
    weight = {(r, e): float(rng.randrange(1, 9)) for r, own in sets.items() for e in own}
    rows = spark.createDataFrame([(r, r % 3, e, w) for (r, e), w in weight.items()], "region long, concept int, entity long, weight double")
    want = {a for a in sets for b in sets if len(sets[a]) < len(sets[b]) and len(sets[a] & sets[b]) / len(sets[a]) >= 0.9}
    assert {r["region"] for r in overlap.contained(rows, 0.9).collect()} == want and 5 < len(want) < 85
    like = set()
    for a in sets:
        for b in sets:
            low = sum(min(weight[a, e], weight[b, e]) for e in sets[a] & sets[b])
            total = sum(weight[r, e] for r in (a, b) for e in sets[r])
            if a < b and a % 3 == b % 3 and low / (total - low) >= 0.2:
                like.add((a % 3, a, b))
    assert {tuple(r) for r in overlap.alike(rows, 0.2).select("part", "a", "b").collect()} == like and len(like) > 20


def test_contained_masks_aggregates_no_pairs_of_other_concepts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(overlap, "pairs", lambda *a, **b: pytest.fail("a row for each pair of regions that share an entity"))
    assert registry.load()["contained_masks"][0](spark, sf_dir).count() == 2


@pytest.fixture
def in_pieces(spark, tmp_path):
    """Writes a table in many row groups that Spark reads in many tasks, and compares a query with its SQL, run by one thread."""
    conf = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def check(query, name, columns):
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet", row_group_size=200)
        run, _, sql = registry.load()[query]
        df = run(spark, str(tmp_path))
        con = duckdb.connect(config={"threads": 1})
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        got, want = [tuple(r) for r in df.collect()], con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, got)) == sorted(map(str, want))
        return want

    yield check
    for k, v in before.items():
        spark.conf.set(k, v)


def cents(rng, n, most):
    return [rng.randrange(most + 1) / 100 for _ in range(n)]


def test_decoded_planes_add_rows_as_stored(in_pieces):
    rng, n = random.Random(8), 12_000
    keys = {"l_suppkey": [rng.randrange(60) for _ in range(n)], "l_linenumber": pa.array([rng.randrange(1, 8) for _ in range(n)], pa.int32())}
    in_pieces("decoded_planes", "lineitem", keys | {"l_tax": cents(rng, n, 8)})


def test_weakest_rank_adds_rows_as_stored(in_pieces):
    rng, n = random.Random(9), 12_000
    in_pieces("weakest_rank", "lineitem", {"l_suppkey": [rng.randrange(200) for _ in range(n)], "l_discount": cents(rng, n, 10), "l_tax": cents(rng, n, 8)})


def test_region_identity_adds_rows_as_stored(in_pieces):
    """Classes of equal sums, and such that are ahead by the least margin."""
    rng, rows = random.Random(10), []
    for region in range(150):
        values = cents(rng, 30, 9999)
        for kind in ("a", "b", "c")[: 2 + region % 2]:
            rows += [(region, kind, v) for v in values]
        if region % 3:
            rows.append((region, "b", 50.0))
    rng.shuffle(rows)
    users, kinds, values = zip(*rows, strict=True)
    want = in_pieces("region_identity", "events", {"user_id": users, "event_type": kinds, "value": values})
    assert {r[3] for r in want} == {"low_margin", "accepted"} and {r[1] for r in want} >= {"a", "b"}


def test_region_identity_of_odd_rows(in_pieces):
    """Null classes are last among equal sums, and a total of zero has no shares."""
    rows = [(1, None, 5.0), (1, "z", 5.0), (2, None, 9.0), (2, "a", 5.0), (3, "a", None), (3, "b", 1.0), (4, "a", None), (None, "a", 1.0), (None, "b", 99.0)]
    rows += [(5, "a", 0.0), (5, "b", 0.0), (6, "a", -1.0), (6, "b", 1.0), (7, "a", float("nan")), (7, "b", 3.0)]
    users, kinds, values = zip(*rows, strict=True)
    in_pieces("region_identity", "events", {"user_id": users, "event_type": kinds, "value": values})
