"""Odd inputs of the operators: nothing learned, unequal rows, hostile pages, empty tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwell.llm import ann, html_extract, language_id, mixing, segmentation, toxicity
from maskwell.llm.queries import MODEL_FILE

LONG = [f"A long paragraph of an article whose words go on and on for the reader, number {i}." for i in range(6)]


def p(text):
    return f"<p>{text}</p>"


# --- languages --------------------------------------------------------------------------------


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame(
        [(1, "some text", None), (2, None, "en"), (3, "", "en"), (4, "...", None)],
        "doc_id bigint, text string, lang string",
    )
    for training in (docs, docs.filter("false"), docs.filter("lang is null")):
        model = language_id.fit(training)
        found = docs.select("doc_id", language_id.predicted(F.col("text"), model).alias("f")).collect()
        assert [r.f.lang for r in found] == ["und"] * 4
        assert all(r.f.score == 0 and r.f.rejected for r in found)


def test_texts_without_letters(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here " * 5
    docs = spark.createDataFrame([(1, text, "en"), (2, text.upper(), "en")], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "123 ...", "the dog", text * 200])], "i int, text string")
    found = {r.i: r.f for r in odd.select("i", language_id.predicted(F.col("text"), model).alias("f")).collect()}
    assert [found[i].lang for i in range(6)] == ["und"] * 4 + ["en"] * 2
    assert odd.filter("false").select(language_id.predicted(F.col("text"), model)).count() == 0


# --- nearest neighbours -----------------------------------------------------------------------


def test_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, [1.0] * 7), (120, []), (140, None), (160, [0.0] * 8), (180, [float("nan")] * 8), (20, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    used = ann.usable(df, "vec_id", "embedding")
    assert used.count() == 60
    found = ann.search(used, used.filter("vec_id % 20 = 0"), ann.fit(used), k=5).collect()
    x = np.array([v for _, v in rows[:60]])
    for q in (0, 20, 40):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(60), -score))[:5].tolist()
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(20, [1.0, 2.0])]])
def test_hardly_any_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    used = ann.usable(df, "vec_id", "embedding")
    assert ann.search(used, used.filter("vec_id % 20 = 0"), ann.fit(used), k=5).count() == 0


def test_ties_of_long_vectors(spark):
    """Equal scores of large numbers go to the smaller id."""
    rows = [(i, [1e6, 1e6 + (i % 3), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    used = ann.usable(df, "vec_id", "embedding")
    found = ann.search(used, used.filter("vec_id = 20"), ann.fit(used), k=6).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [2, 5, 8, 11, 14, 17]


# --- pages ------------------------------------------------------------------------------------


def test_weak_words_do_not_cost_an_article_its_text():
    page = f"<div class='form-group'>{p(LONG[0])}{p(LONG[1])}</div>" + "".join(map(p, LONG[2:]))
    assert html_extract.main_text(page) == "\n".join(LONG)
    page = f"<article>{p(LONG[0])}<blockquote class='alert share'>{p(LONG[1])}</blockquote>{p(LONG[2])}</article>"
    assert html_extract.main_text(page) == "\n".join(LONG[:3])
    page = f"<article>{p(LONG[0])}{p('Press <button>OK</button> now, <label>name</label> it.')}{p(LONG[1])}</article>"
    assert html_extract.main_text(page).split("\n")[1] == "Press OK now, name it."
    page = f"<article>{p(LONG[0])}<p><a href=x>{LONG[1]}</a></p>{p(LONG[2])}</article>"
    assert html_extract.main_text(page) == "\n".join(LONG[:3])


def test_strong_words_and_poor_regions_still_go():
    share = "<div class='share'><a href=x>Tweet</a> <a href=y>Post</a></div>"
    comments = f"<div class='comment-list'>{p('I think so too.')}{p(LONG[5])}</div>"
    form = "<form><label>Mail</label><input><button>Send</button></form>"
    page = f"<article>{p(LONG[0])}{share}{p(LONG[1])}{p(LONG[2])}{p(LONG[3])}{form}</article>{comments}"
    assert html_extract.main_text(page) == "\n".join(LONG[:4])


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" * n + "x" + "</span>" * n,
        lambda n: "<span>" + "<td>" * n + "</span>" * n,
        lambda n: "<div>" + "<b>" * n + "<li></li>" * n,
        lambda n: "".join(f"<div class='ad-x'><p>text {i} with some words</p>" for i in range(n)),
    ],
    ids=["stray ends", "walls", "items", "named regions"],
)
def test_cost_of_a_page_is_linear(page):
    def seconds(n):
        start = time.perf_counter()
        html_extract.main_text(page(n))
        return time.perf_counter() - start

    seconds(100)
    assert seconds(8000) < 40 * max(seconds(800), 0.01)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, html string, text string, doc_id bigint, source string")
    assert html_extract.extract(none.select("page_id", "html")).count() == 0
    assert mixing.mix(none).count() == 0
    vocabulary = segmentation.read_vocabulary(MODEL_FILE)
    assert segmentation.encode(none.select("doc_id", "text"), vocabulary).count() == 0
    model = toxicity.fit(none.select("text", F.lit(1).alias("toxic")))
    assert none.select(toxicity.score(F.col("text"), model)).count() == 0


# --- mixing -----------------------------------------------------------------------------------


def test_the_schedule_is_not_broadcast(spark):
    docs = spark.range(500).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("t").alias("text")
    )
    plan = mixing.mix(docs, block_rows=1, period=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan
