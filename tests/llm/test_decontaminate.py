import random
from itertools import combinations

import pytest

from tallyframe.llm import decontaminate as dc

from .helpers import docs, empty

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(3000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [words(40) for _ in range(12)] + [words(5), []]


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(i, " ".join(w) if w else None, "clash") for i, w in enumerate(items)], "item_id long, text string, hash string")


def brute(texts, items=ITEMS):
    out = set()
    for d, text in enumerate(texts):
        toks = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for k, item in enumerate(items):
            need = min(dc.MIN_TOKENS, len(item))
            for shift in range(-len(item) + 1, len(toks)):
                a, b = max(0, -shift), min(len(item), len(toks) - shift)
                equal = [item[i] == toks[i + shift] for i in range(a, b)]
                if need and any(sum(equal[i : i + need]) >= 0.8 * need for i in range(len(equal) - need + 1)):
                    out.add((d, k))
    return out


def planted():
    out = [None, "", "...", " ".join(words(300))]
    for k in range(12):
        item = list(ITEMS[k])
        for _ in range(k % 5):
            item[RNG.randrange(len(item))] = "substituted"
        out.append(" ".join(words(50)) + ". " + ", ".join(item).upper() + "\n" + " ".join(words(50)))
    out.append(" ".join(ITEMS[0]) + " " + " ".join(ITEMS[1]))
    out.append(" ".join(words(3) + ITEMS[12]))
    out.append(" ".join(words(40000) + ITEMS[3]))
    return out


def test_overlaps_equal_brute_force(spark):
    texts = planted()
    got = {(r["doc_id"], r["item_id"]) for r in dc.overlaps(docs(spark, texts), bench(spark)).collect()}
    want = brute(texts[:-1]) | {(len(texts) - 1, 3)}
    assert got == want
    assert {(4 + k, k) for k in range(12)} <= got


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty_tables(spark, side):
    left = empty(spark) if side == "docs" else docs(spark, planted())
    right = bench(spark).limit(0) if side == "items" else bench(spark)
    assert dc.overlaps(left, right).count() == 0


def test_repeated_rows_give_one(spark):
    d = docs(spark, [" ".join(ITEMS[2])])
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in dc.overlaps(d.union(d), bench(spark)).collect()] == [(0, 2, 40)]


def test_keep_clean_drops_overlaps_only(spark):
    texts = planted()
    d = docs(spark, texts)
    kept = dc.keep_clean(d, bench(spark))
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {x for x, _ in brute(texts[:-1])} - {len(texts) - 1}


def allowed(n):
    return next(m for m in range(n, -1, -1) if n - m >= 0.8 * n - 1e-9)


@pytest.mark.parametrize("n", range(1, 14))
def test_masks_miss_every_placement(n):
    masks = [[k for k, bit in enumerate(m) if bit == "1"] + [len(m) - 1] for m in dc.masks_of(n, dc.SIMILARITY)]
    for spoilt in combinations(range(n), allowed(n)):
        assert any(not {at + k for k in m[:-1]} & set(spoilt) for m in masks for at in range(n - m[-1]))


def test_every_placement_of_substitutions_is_found(spark):
    items = [words(n) for n in (20, 13, 12, 11, 10, 9, 7, 5)]
    texts, want = [], set()
    for k, item in enumerate(items):
        n = min(13, len(item))
        for spoilt in combinations(range(n), allowed(n)):
            # Of the longest item only the first 13 tokens stand in the text.
            part = [f"other{i}" if i in spoilt else w for i, w in enumerate(item[:n])]
            want.add((len(texts), k))
            texts.append(" ".join(words(20) + part + words(20)))
    got = {(r["doc_id"], r["item_id"]) for r in dc.overlaps(docs(spark, texts), bench(spark, items)).collect()}
    assert want <= got and got == brute(texts, items)


def brute_matched(text, item):
    """Most equal aligned tokens of any alignment that has a similar stretch."""
    toks, best, need = text.split(), 0, min(13, len(item))
    for shift in range(-len(item) + 1, len(toks)):
        equal = [item[i] == toks[i + shift] for i in range(max(0, -shift), min(len(item), len(toks) - shift))]
        if any(sum(equal[i : i + need]) >= 0.8 * need for i in range(len(equal) - need + 1)):
            best = max(best, sum(equal))
    return best


def test_matched_counts_whole_alignments(spark):
    rng = random.Random(2)
    items = [words(300), words(90), words(20), words(6)]
    texts = []
    for item in items:
        for share in (0.0, 0.1, 0.5):
            part = ["other" if rng.random() < share else w for w in item]
            # One stretch is left whole, so that a pair is found whatever the rest looks like.
            at = rng.randrange(max(1, len(item) - 13))
            part[at : at + 13] = item[at : at + 13]
            texts.append(" ".join(words(7) + part + words(9)))
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["item_tokens"]) for r in dc.overlaps(docs(spark, texts), bench(spark, items)).collect()}
    assert {d: k for d, k in got} == {d: d // 3 for d in range(12)}
    assert all(n == len(items[k]) and m == brute_matched(texts[d], items[k]) for (d, k), (m, n) in got.items())
