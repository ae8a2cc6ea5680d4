"""Filters and facets by bitmaps against the same filters over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import bitmaps as B
from quillstone.operators import retrieval as R
from quillstone.operators.where import compile_where

FIELDS = ["type", "page", "flag", "tags"]
TREES = [
    None, {}, {"type": "a"}, {"type": {"$ne": "a"}}, {"type": {"$in": ["a", None]}}, {"type": {"$nin": ["a", None]}}, {"type": {"$nin": []}}, {"type": {"$in": []}}, {"type": None}, {"type": "None"}, {"type": {"$eq": None}},
    {"page": 3}, {"page": {"$ne": 3, "$in": [1, 2, 3]}}, {"flag": {"$eq": True}}, {"flag": {"$ne": False}}, {"gone": {"$ne": 1}}, {"gone": "x"}, {"gone": "None"}, {"gone": {"$nin": [None]}},
    {"$and": [{"type": "a"}, {"$or": [{"page": 1}, {"flag": {"$eq": True}}]}]}, {"$or": []}, {"$and": []}, {"$or": [{"type": ""}, {"type": "A"}]}, {"type": {"$in": ["a", "b"]}, "page": {"$ne": 0}},
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(3)
    keys = [-129, -64, -1, 0, 63, 64, 2**62, *rng.sample(range(100, 5000), 600)]
    data = [(k, rng.choice(["a", "a", "b", "A", "", "None", None]), rng.choice([0, 1, 2, 3, None]), rng.choice([True, False, None]), rng.choice([None, [], ["x"], ["x", "y", "x"], [None, "y"]])) for k in keys]
    rows = spark.createDataFrame(data, "key long, type string, page int, flag boolean, tags array<string>").repartition(3)
    return rows, B.write_bitmaps(B.entries(rows, "key", FIELDS), f"file://{tmp_path_factory.mktemp('bitmaps')}/b")


def found(df):
    return sorted(r["key"] for r in df.collect())


@pytest.mark.parametrize("tree", TREES, ids=str)
def test_filters_mean_what_they_mean_over_rows(made, tree):
    rows, index = made
    want = found(rows.where(compile_where(tree, FIELDS)))
    chosen = B.select(index, tree, FIELDS)
    assert found(B.keys(chosen)) == want
    assert found(B.among(rows, chosen, "key")) == want


def test_lists_count_in_each_of_their_values(made):
    rows, index = made
    assert found(B.keys(B.select(index, {"tags": {"$eq": "x"}}, FIELDS))) == found(rows.where(F.array_contains("tags", "x")))
    assert found(B.keys(B.select(index, {"tags": {"$ne": "y"}}, FIELDS))) == found(rows.where("NOT coalesce(array_contains(tags, 'y'), false)"))


def test_unknown_operators_are_errors(made):
    with pytest.raises(ValueError, match="unknown filter operator"):
        B.select(made[1], {"type": {"$gt": 1}}, FIELDS)


def test_facets_of_several_filters_at_once(made):
    rows, index = made
    filters = {"all": None, "a": {"type": "a"}, "none": {"type": "zzz"}, "not": {"page": {"$ne": 1}}}
    got = {(r["filter"], r["field"], r["value"]): r["n"] for r in B.facets(index, filters, ["type", "page"], FIELDS).collect()}
    want = {}
    for name, tree in filters.items():
        for f in ("type", "page"):
            want |= {(name, f, r["v"]): r["count"] for r in rows.where(compile_where(tree, FIELDS)).groupBy(F.col(f).cast("string").alias("v")).count().collect()}
    assert got == want


def test_repeated_and_missing_keys_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (1, "a")], "key long, type string")
    index = B.write_bitmaps(B.entries(rows, "key", ["type"]), f"file://{tmp_path}/b")
    assert found(B.keys(B.select(index, {"$and": [{"type": "a"}, {"type": "b"}]}, ["type"]))) == [1]
    none = B.write_bitmaps(B.entries(rows.where("false"), "key", ["type"]), f"file://{tmp_path}/none")
    assert B.keys(B.select(none, None, ["type"])).count() == 0
    assert B.facets(none, {"all": None}, ["type"], ["type"]).count() == 0


@pytest.mark.parametrize("k", [3, 50])
def test_ranking_by_words_is_ranking_by_a_condition_and_reads_no_rows(spark, tmp_path, k):
    rng = random.Random(9)
    data = [(f"r{i}", 70 * i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(1, 30))), rng.choice("ab")) for i in range(300)]
    rows = spark.createDataFrame(data, "id string, seq long, text string, type string")
    index = R.write_index(rows, f"file://{tmp_path}/i{k}", 2)
    words = B.write_bitmaps(B.entries(rows, "seq", ["type"]), f"file://{tmp_path}/b{k}")
    chosen = B.select(words, {"type": {"$ne": "b"}}, ["type"])
    got, want = (index.top(["w1", "w2", "w59"], k, w).select("id", "score", "lex_rank").orderBy("lex_rank").collect() for w in (chosen, F.col("type") != "b"))
    assert got == want and len(got) == k
    read = index.best(index.asked(["w1", "w2"]), k, chosen).inputFiles()
    assert any("/forward/" in f for f in read) and not any("/rows/" in f for f in read)


def test_values_reach_the_scan(made):
    plan = B.select(made[1], {"type": "a"}, FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "EqualTo(field,type)" in plan
