import math
import random
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import quality

from .helpers import docs, empty


def corpus(n=400):
    rng = random.Random(2)
    out = []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 80))]
        out.append(" ".join(w).capitalize() + "." if i % 4 else " ".join(x + "%%%" for x in w))
    return out


def labels(spark, n=400):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    d = docs(spark, corpus())
    model = quality.train(d, labels(spark))
    got = quality.score(d, model).withColumn("ho", quality.held_out(F.col("doc_id"))).where("ho").collect()
    right = [(r["score"] >= 0.7) == (r["doc_id"] % 4 > 0) for r in got]
    assert len(right) > 50 and np.mean(right) > 0.95
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and abs(kept.count() - 300) < 12


def test_odd_texts_and_labels(spark):
    d = docs(spark, corpus() + [None, "", " \n", "one", "x " * 300000])
    odd = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (2, None, 0), (3, 5, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels(spark).union(odd))
    got = {r["doc_id"]: r["score"] for r in quality.score(d.union(d.limit(1)), model).collect()}
    assert len(got) == 405 and all(0 <= s <= 1 for s in got.values())
    assert got[400] == got[401] == got[402]


def test_no_evidence_and_empty_tables(spark):
    d = docs(spark, corpus(8))
    model = quality.train(d, labels(spark).limit(0))
    assert {r["score"] for r in quality.score(d, model).collect()} == {0.5}
    assert quality.keep_good(d, model).count() == 8
    one_kind = spark.createDataFrame([(i, 0, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(d, quality.train(d, one_kind)).count() == 8
    assert quality.score(empty(spark), model).count() == 0
    assert quality.train(empty(spark), labels(spark)) is quality.NO_EVIDENCE


def test_hinge_loss_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 5, replace=False)) for _ in range(60)]
    y = np.where(rng.random(60) > 0.5, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(20), epochs=3000)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - t * (w[r].sum() + b)) for r, t in zip(rows, y))

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.02, 20), b + rng.normal(0, 0.02)) >= best - 1e-2


WIDE = 1 << 64


def slot(x):
    return (x * 0x9E3779B97F4A7C15 % WIDE) >> (64 - quality.BITS)


def brute_features(text):
    """The indicators by plain loops: byte trigrams, pairs of word shapes, and shares of frequent pairs and of repetition."""
    raw, out = text.encode(), set()
    if not raw.strip():
        return out
    out |= {slot(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2)}
    words = raw.split()
    kind = lambda b: "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
    shapes = ["".join(c for c, d in zip(s, [None, *s]) if c != d) for s in ("".join(map(kind, w)) for w in words)]
    codes = [xxhash.xxh64_intdigest(s.encode("latin-1")) for s in shapes]
    pairs = [(a * 3 + b * 1_000_003) % WIDE for a, b in zip(codes, codes[1:])]
    steps = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
    for p in set(pairs):
        share = pairs.count(p) / len(pairs)
        out |= {slot(p)} | {slot((p * 31 + 7919 + k) % WIDE) for k, s in enumerate(steps) if share >= s}
    if pairs:
        same = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        out |= {slot(5 * 31 + 7919 + k) for k, s in enumerate(steps) if same >= s}
    return out


def test_features_equal_brute_force():
    long = "Abc" * 30
    for text in [*corpus(40), "", " ", "a", "ab cd", "Éa Ünd 12.50 $x " * 9, f"{long}x {long}y {long}", "no no no no yes"]:
        assert set(quality.features(text.encode()).tolist()) == brute_features(text)


def test_scores_equal_brute_force(spark):
    """Ratios by counting, the same solver, and the sigmoid by hand; held-out labels never count."""
    texts = corpus(240)
    d = docs(spark, texts)
    flipped = labels(spark, 240).withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality.train(d, flipped)
    order = {r["doc_id"]: (r["o"], r["h"]) for r in d.select("doc_id", F.xxhash64("doc_id").alias("o"), quality.held_out(F.col("doc_id")).alias("h")).collect()}
    train = sorted((i for i in range(240) if not order[i][1]), key=lambda i: order[i][0])
    sets = [np.array(sorted(brute_features(texts[i]))) for i in train]
    y = np.array([int(i % 4 > 0) for i in train])
    count = np.ones((2, quality.SLOTS))
    for label, s in zip(y, sets):
        for k in s:
            count[label, k] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    scale = ratio / np.median([math.sqrt(sum(ratio[k] ** 2 for k in s)) for s in sets])
    w, b = quality.dual_coordinate_descent(sets, np.where(y == 1, 1.0, -1.0), scale)
    assert np.allclose(w, model.weights) and np.isclose(b, model.bias)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    for i, text in enumerate(texts):
        margin = sum(w[k] for k in brute_features(text)) + b
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.offset)))), rel_tol=1e-9)


def test_fitting_holds_slots_only():
    """The driver's memory: two bytes a slot of the sample, which come with the rows, and no value beside it."""
    rng = np.random.default_rng(4)
    rows = [rng.choice(5000, 500, replace=False).astype(np.uint16) for _ in range(1000)]
    y, scale = np.where(np.arange(1000) % 2, 1.0, -1.0), rng.normal(size=5000)
    tracemalloc.start()
    quality.dual_coordinate_descent(rows, y, scale, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(r.nbytes for r in rows)
