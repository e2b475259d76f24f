import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import simhash
from tallyframe.operators.graph import components

from .helpers import docs, empty


def brute_fp(text, words=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab cd Efg hij klm nop É x qrs".split(" ")) + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 80, 400]))) for _ in range(n)]
    out = [None, "", " \t\n", "word", "WORD", "two words", *base]
    out.append(" ".join(f"long{rng.randrange(9)}" for _ in range(40_000)))
    for t in base[:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out += [t, " ".join(w)]
    return out


def test_components_equal_brute_force(spark):
    rows = texts()
    got = {r["id"]: r for r in simhash.near_duplicates(docs(spark, rows, first=100)).collect()}
    fps = [brute_fp(t) for t in rows]
    assert [got[100 + i]["fp"] % (1 << 64) for i in range(len(rows))] == fps
    assert [got[100 + i]["component"] - 100 for i in range(len(rows))] == brute_components(fps, 2)


def test_links_survive_splitting_of_large_nodes(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    centre = 0x0123456789ABCDEF
    for _ in range(300):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for leaf in (16, 64, 4096):
        roots = dict(components(simhash.links(frame, 2, leaf=leaf)).collect())
        ours = [roots.get(simhash._signed(x), simhash._signed(x)) for x in fps]
        want = brute_components(fps, 2)
        assert len({(a, b) for a, b in zip(ours, want)}) == len(set(ours)) == len(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_index_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 12, 300), rng.integers(0, 1 << 62, 200)]).astype(np.uint64))
    i, j = simhash.near_pairs(fps, radius)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_components_of_chains_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (201, 200), (200, 201), (None, 3), (4, None)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and got[200] == got[201] == 200 and 100 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_null_ids_repeated_rows_and_empty_table(spark):
    frame = docs(spark, ["same text here now", "same text here now", "other words stand there"])
    frame = frame.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(frame.union(frame)).collect()), key=str)
    assert got == sorted([(None, 1), (None, 1), (1, 1), (1, 1), (2, 2), (2, 2)], key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def word_sets(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar_corpus(seed=9):
    rng = random.Random(seed)
    out = [None, "", "a", "A"]
    for _ in range(60):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 600]))]
        out.append(" ".join(w))
        for rate in (0.005, 0.01, 0.02):
            out.append(" ".join("new" if rng.random() < rate else x for x in w))
    return out


@pytest.mark.parametrize("node", [2048, 8])
def test_similar_texts_meet(spark, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE", node)
    texts_ = similar_corpus()
    got = {r["id"]: r["component"] for r in simhash.similar_groups(docs(spark, texts_)).collect()}
    assert len(got) == len(texts_)
    sets = [word_sets(t) for t in texts_]
    found = wanted = 0
    for i in range(len(texts_)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            s = len(sets[i] & sets[j]) / both if both else 1.0
            if s >= 0.8:
                wanted += 1
                found += got[i] == got[j]
            elif s < 0.3 and (i < 4 or j < 4 or (i - 4) // 4 != (j - 4) // 4):
                assert got[i] != got[j]
    assert wanted > 100 and found >= 0.95 * wanted
    assert simhash.similar_groups(empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    texts_ = similar_corpus()[:40]
    d = docs(spark, texts_ * 2)
    kept = simhash.keep_one(d.union(d))
    assert kept.columns == d.columns
    groups = {r["id"]: r["component"] for r in simhash.similar_groups(d).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and sorted(groups[i] for i in ids) == sorted(set(groups.values()))


def exact_groups(texts_, similarity=0.8):
    sets = [word_sets(t) for t in texts_]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= similarity * both:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edge_corpus():
    """Pairs just at and just below 0.8, repeated lines, and texts of four and five shingles."""
    rng = random.Random(21)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    out = []
    for _ in range(120):
        # 180 shingles each, 160 shared: 0.8; then 159 shared: 159 / 201.
        w = words(164)
        out += [" ".join(w + words(20)), " ".join(w + words(20))]
        w = words(163)
        out += [" ".join(w + words(21)), " ".join(w + words(21))]
        w = words(9)
        out += [" ".join(w[:8]), " ".join(w)]
    for _ in range(10):
        w, line = words(304), words(12)
        out += [" ".join(w), " ".join(w + line * 5), " ".join(w + line * 20)]
    return out


@pytest.mark.parametrize("node", [2048, 8])
def test_similar_groups_equal_exact_jaccard(spark, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE", node)
    texts_ = edge_corpus() + similar_corpus()
    got = {r["id"]: r["component"] for r in simhash.similar_groups(docs(spark, texts_)).collect()}
    assert [got[i] for i in range(len(texts_))] == exact_groups(texts_)


@pytest.mark.parametrize("blocks", [512, 7])
def test_one_large_group_similar_below_and_above(spark, monkeypatch, blocks):
    """Copies of one text at all similarities: links within blocks and between them are found, others not."""
    monkeypatch.setattr(simhash, "SET_ROWS", blocks)
    monkeypatch.setattr(simhash, "NODE", 16)
    rng = random.Random(31)
    base = [f"b{rng.randrange(10**6)}" for _ in range(250)]
    texts_ = []
    for k in range(160):
        rate = (0.003, 0.01, 0.03, 0.06)[k % 4]
        texts_.append(" ".join(f"n{rng.randrange(10**6)}" if rng.random() < rate else w for w in base))
    texts_ += similar_corpus(4)[:60]
    got = {r["id"]: r["component"] for r in simhash.similar_groups(docs(spark, texts_)).collect()}
    want = exact_groups(texts_)
    assert [got[i] for i in range(len(texts_))] == want
    assert 10 < len(set(want[:160])) < 120


def test_recall_at_the_threshold():
    """Of 2,000 pairs between 0.8 and 0.85, by the sketches alone: all meet in a node and lie within the radius."""
    rng = np.random.default_rng(6)
    layout, missed = simhash.layout_for(10**6, 0.8), 0
    for _ in range(2000):
        n = int(rng.integers(80, 400))
        union = rng.integers(0, 1 << 63, int(n / 0.8 * 0.999)).astype(np.uint64)
        both = int(np.ceil(rng.uniform(0.8, 0.85) * len(union)))
        cut = (both + len(union)) // 2
        sets = [np.unique(union[:cut]), np.unique(np.concatenate([union[:both], union[cut:]]))]
        packed = np.stack([np.packbits(simhash.sketch(x, layout.mixers), bitorder="little").view("<u8") for x in sets])
        meet = (layout.pieces(packed)[0] == layout.pieces(packed)[1]).any()
        sizes = np.array([len(x) for x in sets])
        found = any(len(i) for i, _, _ in simhash.similar_pairs(packed[:, : simhash.SENT], sizes, np.array([0]), np.array([1]), 0.8))
        missed += not (meet and found)
    assert missed <= 2
