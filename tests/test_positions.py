"""Phrases from positional postings against a search through the words of each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import positions as P
from quillstone.operators.search import Concept


def brute(texts, phrase):
    q = re.findall("[a-z0-9]+", phrase.lower())
    out = {}
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if q and (at := [k for k in range(len(w)) if w[k : k + len(q)] == q]):
            out[i] = at
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "c", "New", "york"], k=rng.randrange(40))) for _ in range(200)] + [None, "", "!!", "new york new york new york", "a " * 30_000 + "b c"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string").repartition(3)
    return texts, P.write_positions(docs, f"file://{tmp_path_factory.mktemp('positions')}/p")


@pytest.mark.parametrize("lookup", [1000, 2])
def test_phrases_are_found_where_the_words_stand(spark, made, monkeypatch, lookup):
    texts, index = made
    monkeypatch.setattr(P, "LOOKUP", lookup)
    phrases = ["a", "a b", "b c a", "new york new york", "a a a", "york, NEW", "zzz", "a zzz", "", "?!", "a b", "b c"]
    got = {(r["phrase"], r["id"]): r["places"] for r in P.holding(index, spark.createDataFrame([("k", p) for p in phrases], "key string, phrase string")).collect()}
    assert got == {(p, i): at for p in phrases for i, at in brute(texts, p).items()}


def test_boolean_searches_and_funnel(spark, made):
    texts, index = made
    concepts = [Concept("one", ["a b", "b c"]), Concept("two", ["york new"]), Concept("three", ["c c c"], required=False)]
    sets = [set().union(*(brute(texts, t) for t in c.terms)) for c in concepts]
    assert {r["id"] for r in P.matching(index, concepts).collect()} == sets[0] & sets[1] & sets[2]
    assert {r["id"] for r in P.matching(index, concepts, "broad").collect()} == sets[0] & sets[1]
    assert P.matching(index, concepts, language="fr").count() == 0
    assert [r["total_count"] for r in P.funnel(index, concepts).orderBy("step").collect()] == [len(sets[0]), len(sets[0] & sets[1]), len(sets[0] & sets[1] & sets[2])]


def test_empty_tables(spark, made, tmp_path):
    _, index = made
    none = spark.createDataFrame([], "id long, lang string, text string")
    empty = P.write_positions(none, f"file://{tmp_path}/p")
    assert P.funnel(empty, [Concept("one", ["a"])]).collect()[0]["total_count"] == 0
    assert P.holding(index, spark.createDataFrame([], "key string, phrase string")).count() == 0


def test_no_text_is_read_and_words_reach_the_scan(made):
    _, index = made
    plan = P.matching(index, [Concept("one", ["a b"])])._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("TextBased", "") and re.search(r"PushedFilters: \[.*In\(term", plan)


def test_postings_stay_with_the_task_that_read_the_row(spark, tmp_path):
    docs = spark.range(0, 40, 1, 4).selectExpr("id", "'en' AS lang", "'a few of the words that all rows have' AS text")
    made = P.write_positions(docs, f"file://{tmp_path}/p").postings.select("id", F.input_file_name().alias("f")).distinct()
    assert made.count() == 40 and made.select("f").distinct().count() == 4
