import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import mixing

from .helpers import docs, empty


def corpus(spark, n=600):
    rng = random.Random(4)
    d = docs(spark, [None, "", " \t"] + ["w " * rng.randrange(1, 200) for _ in range(n)] + ["long " * 20000])
    pick = F.pmod(F.col("doc_id") * F.col("doc_id"), F.lit(11))
    return d.withColumn("source", F.when(pick == 0, None).when(pick < 5, "big").when(pick < 9, "Ébig").otherwise("a"))


def brute_targets(sizes, weights, cap):
    t, fixed = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(t[i] for i in fixed)
        w = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in fixed)
        for i in range(len(sizes)):
            if i not in fixed:
                t[i] = left * weights[i % len(weights)] / w
        over = [i for i in range(len(sizes)) if i not in fixed and t[i] > cap * sizes[i]]
        if not over:
            return t
        for i in over:
            t[i] = cap * sizes[i]
        fixed |= set(over)


def test_targets_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 100000]) for _ in range(rng.randrange(1, 9))]
        if len({i for i, n in enumerate(sizes) if n}) and sum(sizes):
            got = mixing.targets(sizes)
            assert np.allclose(got, brute_targets(sizes, mixing.WEIGHTS, mixing.CAP))


def test_exact_quotas_and_reruns(spark):
    d = corpus(spark)
    rows = mixing.mix(d, shard_words=3000).collect()
    assert len(rows) == d.count()
    by_target = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(x["words"] for x in r["draws"])
        by_target.setdefault((r["source_size"], r["target"]), []).append(r)
    assert len(by_target) == 4
    for (size, target), own in by_target.items():
        assert sum(r["size"] for r in own) == size
        assert sum(r["taken"] for r in own) == int(target + 1e-6)
    again = mixing.mix(d.repartition(7), shard_words=3000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len({x["shard"] for r in rows for x in r["draws"]}) > 3


def test_tree_keeps_counts():
    rng = np.random.default_rng(0)
    counts = np.array([100, 0, 37, 5])
    capacity = np.array([20, 20, 21, 27, 27, 27])
    quotas = mixing.split(counts, capacity, rng)
    assert (quotas.sum(axis=0) == counts).all() and (quotas.sum(axis=1) == capacity).all()


def test_shards_hold_every_draw_once(spark):
    mixed = mixing.mix(corpus(spark), shard_words=3000)
    out = mixing.shards(mixed).collect()
    assert len(out) == sum(len(r["draws"]) for r in mixed.collect())


def test_repeated_rows_null_ids_and_empty_table(spark):
    d = docs(spark, ["a b c"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r["size"], r["taken"]) for r in mixing.mix(d.union(d)).collect()] == [(3, 3)] * 4
    assert mixing.mix(empty(spark)).count() == 0


def test_drawn_is_the_mixed_corpus(spark):
    d = corpus(spark)
    got = mixing.drawn(d.withColumn("size", F.lit("clash")), shard_words=3000)
    assert got.columns == [*d.columns, *mixing.OWN]
    rows = got.collect()
    want = {r["doc_id"]: r for r in mixing.mix(d, shard_words=3000).collect()}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["pass"], r["taken"], r["shard"]))
        assert len(r["text"].split()) == r["taken"] and text[r["doc_id"]].startswith(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted((x["pass"], x["words"], x["shard"]) for x in r["draws"]) for k, r in want.items() if r["draws"]}
    # Shards follow one another, and within one the order is not that of the ids.
    order = [r["shard"] for r in rows]
    assert order == sorted(order)
    first = [r["doc_id"] for r in rows if r["shard"] == order[0]]
    assert first != sorted(first)


def test_several_shards_without_options(spark):
    rows = mixing.mix(corpus(spark)).collect()
    assert {x["shard"] for r in rows for x in r["draws"]} == set(range(mixing.MIN_SHARDS))


def test_cut_among_many_equal_places(spark, monkeypatch):
    """Prefixes of three bits a round, and rows equal in id and text at the cut."""
    monkeypatch.setattr(mixing, "STEP_BITS", 3)
    d = corpus(spark, 200)
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, mixing.mix(d.repartition(3)).collect()))
    one = docs(spark, ["w " * 10, "x " * 20, "y " * 5]).withColumn("source", F.col("text").substr(1, 1))
    same = one.union(one).union(one)
    totals = {r["source_size"]: r["taken"] for r in mixing.mix(same).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    targets = mixing.targets([30, 60, 15])
    # At most as many words are missing as rows are equal.
    assert all(0 <= t - totals[n] < 3 for n, t in zip((30, 60, 15), targets))
