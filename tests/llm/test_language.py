import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language

from .helpers import docs, empty

WORDS = {"en": "the of and with from this that".split(), "de": "der und die nicht schön für ein".split(), "fr": "le où être avec pour dans élève".split()}
PAGE = "page_id long, url string, html string, host string, vote int"


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def training(spark):
    rng = random.Random(0)
    langs = [rng.choice(list(WORDS)) for _ in range(90)] + [None, "en"]
    d = docs(spark, [text(rng, x) for x in langs[:90]] + ["no label", None])
    pick = F.create_map(*[F.lit(x) for i, x_ in enumerate(langs) for x in (i, x_)])
    return d.withColumn("lang", pick[F.col("doc_id").cast("int")])


def pages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = ["en", "de", "fr"][i % 3]
        html = f'<html lang="{lang if i % 10 else "en"}-XX"><script>{text(rng, "fr")}</script><p>{text(rng, lang)}</p></html>'
        rows.append((i, f"http://h{i % 3}.site{i % 3}.{['com', 'de', 'fr'][i % 3]}/x", html, "clash", 1))
    rows += [
        (300, "http://h1.site1.de/empty", None, "c", 1),
        (301, "http://other.site1.de/empty", "", "c", 1),
        (302, None, '<html lang="de"></html>', "c", 1),
        (303, "::bad", "<p>" + "the of and " * 50000, "c", 1),
        (None, "http://new.zz/", "<p>der und die nicht", "c", 1),
    ]
    return spark.createDataFrame(rows, PAGE)


def test_pages(spark):
    model = language.train(training(spark))
    assert model.languages == ("de", "en", "fr")
    got = {r["page_id"]: r for r in language.of_pages(pages(spark), model).collect()}
    assert len(got) == 205
    assert all(got[i]["lang"] == ["en", "de", "fr"][i % 3] for i in range(200))
    # Without text: the host, the domain of an unseen host, and the declaration decide.
    assert (got[300]["lang"], got[301]["lang"], got[302]["lang"]) == ("de", "de", "de")
    assert got[300]["text_lang"] is None and got[303]["lang"] == "en" and got[None]["lang"] == "de"
    assert all(0 < r["confidence"] <= 1 for r in got.values())


def test_prior_equals_brute_force(spark):
    """Two rows of one host whose own votes are taken out, without other evidence."""
    model = language.train(training(spark))
    rng = random.Random(3)
    d = docs(spark, [text(rng, "de") for _ in range(3)] + [""])
    got = {r["doc_id"]: r for r in language.of_documents(d, model).collect()}
    base = [(3 + 1) / (3 + 3), 1 / 6, 1 / 6]
    domain = base
    host = [(3 + 20 * domain[0]) / 23, 20 * domain[1] / 23, 20 * domain[2] / 23]
    assert got[3]["lang"] == "de" and got[3]["confidence"] == pytest.approx(host[0] / sum(host))


def test_documents_and_accuracy(spark):
    d = training(spark)
    got = language.of_documents(d, language.train(d)).join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("truth is not null and text_lang is not null and lang <> truth").count() == 0
    assert got.count() == 92


def test_nothing_known_and_empty_tables(spark):
    nothing = language.train(empty(spark))
    assert nothing.languages == () and math.prod(nothing.logs.shape) == 0
    assert {r["lang"] for r in language.of_documents(docs(spark, ["a", None]), nothing).collect()} == {None}
    model = language.train(training(spark))
    assert language.of_pages(pages(spark).limit(0), model).count() == 0


def test_markup_ends_where_it_should():
    assert language.visible("a<b>c</b>d").split() == ["a", "c", "d"]
    assert language.visible("x<script>var a = '<b>';</script >y<style>p{}</STYLE>z<!-- <p> -->w").split() == ["x", "y", "z", "w"]
    assert language.visible("a < b").split() == ["a", "<", "b"]
    assert language.visible("a <!-- open <p>b").split() == ["a", "b"]
    assert language.visible("a <script>b").split() == ["a", "b"] and language.visible("&amp;a&nbsp;").split() == ["a"]
    assert language.visible("<scripted>t</scripted>") .split() == ["t"] and language.visible("") == ""


@pytest.mark.parametrize("piece", ["<", "<script ", "<!--", "<script>", "</script", "<style x", "<html ", "-->", "<a>", "&", "lang ="])
def test_five_megabytes_of_markup_end_soon(piece):
    page = piece * (5_000_000 // len(piece))
    start = time.time()
    language.visible(page)
    language.visible(page + "<p>" + page)
    assert time.time() - start < 25


def test_very_long_pages_and_clashing_columns(spark):
    model = language.train(training(spark))
    rows = [(i, f"http://h.site{i}.de/", piece * (2_000_000 // len(piece)) + '<html lang="de">', "c", 1) for i, piece in enumerate(["<html ", "<!--", "lang ", "<script "])]
    rows.append((9, "http://h.x.de/", "<p>und</p>" * 10 + "<HTML class='x' LANG = 'fr-FR'><html lang=en>", "c", 1))
    start = time.time()
    got = {r["page_id"]: r["declared"] for r in language.of_pages(spark.createDataFrame(rows, PAGE).withColumn("domain", F.lit(1)), model).collect()}
    # The first tag decides; one that never ends has the language it holds.
    assert got[9] == "fr" and got[1] == "de" and got[2] == "de"
    assert time.time() - start < 120


def test_accuracy_on_rows_left_out(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = language.train(sf.where(~out))
    held = sf.where(out & F.col("lang").isNotNull()).withColumn("source", F.lit(None).cast("string"))
    got = language.of_documents(held, model).join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("text_lang is not null")
    n = got.count()
    assert n > 100 and got.where("text_lang = truth").count() >= 0.9 * n
