"""The corpus pipeline on a small fixture, every stage against a brute-force version of its rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tallyframe.llm import mixing, quality

from .helpers import DOCS

RNG = random.Random(11)
WORDS = [f"w{i}x" for i in range(4000)]
ITEMS = [[RNG.choice(WORDS) for _ in range(30)] for _ in range(5)]


def prose(n=120):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    texts = [None, "", "short one"]
    for i in range(300):
        texts.append(prose() if i % 5 else " ".join(w + "%%%" for w in prose().split()))
    base = [prose(300) for _ in range(12)]
    for t in base:
        w = t.split()
        w[RNG.randrange(5, 290)] = "edited"
        texts += [t, t, " ".join(w)]
    texts += [prose(40) + " " + " ".join(item) + " " + prose(40) for item in ITEMS]
    texts += [prose(50) + " password=Abcdef123456 " + prose(50) for _ in range(4)]
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, prose(), None, None, None, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 0 if "%%%" in (t or "") else 1, 0) for i, t in enumerate(TEXTS) if i % 2 or i > 250]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(ITEMS)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def staged(spark, sf):
    """The rows before the first and after every stage, each written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{sf}/out-{k}")
        out.append(spark.read.parquet(f"{sf}/out-{k}"))
    return out


def keys(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_columns_stay_until_the_last(staged):
    for df in staged[1:-1]:
        assert df.columns == staged[0].columns
    assert staged[-1].columns == [*staged[0].columns, *mixing.OWN]


def test_quality(spark, sf, staged):
    model = quality.train(staged[0], spark.read.parquet(f"{sf}/labels.parquet")).plain()
    want = [(r["doc_id"], r["text"]) for r in staged[0].collect() if quality.score_of(model, quality.features((r["text"] or "").encode())) >= 0.7]
    assert keys(staged[1]) == sorted(want, key=str)
    kept = {d for d, _ in want}
    assert not any("%%%" in (TEXTS[d] or "") for d in kept if d is not None) and len(kept) > 280


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged[1].collect()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = keys(staged[2])
    assert len(kept) == len({find(i) for i in range(len(rows))})
    assert set(kept) <= set(rows)


def test_benchmark(staged):
    def has(text):
        w = (text or "").split()
        return any(sum(a == b for a, b in zip(w[i : i + 13], item[j : j + 13], strict=False)) >= 11 for item in ITEMS for j in range(len(item) - 12) for i in range(len(w) - 12) if w[i] == item[j] or w[i + 1] == item[j + 1])

    want = [(r["doc_id"], r["text"]) for r in staged[2].collect() if not has(r["text"])]
    assert keys(staged[3]) == sorted(want, key=str)
    assert staged[2].count() - staged[3].count() == len(ITEMS)


def test_secrets(staged):
    rule = re.compile(r"password=[A-Za-z0-9]{8,}")
    want = sorted(((r["doc_id"], None if r["text"] is None else rule.sub("[assign]", r["text"])) for r in staged[3].collect()), key=str)
    assert keys(staged[4]) == want and sum("[assign]" in (t or "") for _, t in want) == 4


def test_mixing(staged):
    sizes = {}
    for r in staged[4].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([sizes[n] for n in names])))
    taken = {r["source"]: r["t"] for r in staged[5].groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert {n: taken.get(n, 0) for n in names} == {n: int(target[n] + 1e-6) for n in names}
    assert all(0 < r["taken"] <= 3 * r["size"] for r in staged[5].collect())


def test_run_equals_the_stages(spark, sf, staged):
    assert sorted(map(str, cp.run(spark, sf).collect())) == sorted(map(str, staged[5].collect()))


def test_empty_documents(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
