"""Small cases of the operators, with the edge cases that the large tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import biblio as B
from quillstone.operators import claims as C
from quillstone.operators import library as L
from quillstone.operators import parsing as P
from quillstone.operators import retrieval as R
from quillstone.operators import search as S
from quillstone.operators.where import both, build, compile_where


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


ROWS = [("a", "text", "1", None), ("b", "claim", "2", "en"), ("c", None, "1", "de")]


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (None, "abc"), ({}, "abc"), ({"type": "text"}, "a"), ({"type": {"$eq": "claim"}}, "b"), ({"type": {"$ne": "claim"}}, "ac"), ({"type": {"$in": ["text", None]}}, "ac"),
        ({"type": {"$nin": ["text"]}}, "bc"), ({"lang": {"$nin": ["en"]}}, "ac"), ({"pmid": 1}, "ac"), ({"type": "None"}, "c"), ({"gone": {"$eq": 1}}, ""), ({"gone": {"$ne": 1}}, "abc"),
        ({"$and": [{"pmid": "1"}, {"type": "text"}], "lang": "xx"}, "a"), ({"$or": [{"lang": "de"}, {"type": "claim"}]}, "bc"), ({"type": {"$in": []}}, ""), ({"$or": []}, ""), ({"$and": []}, "abc"),
    ],
)
def test_where(spark, tree, want):
    df = spark.createDataFrame(ROWS, "id string, type string, pmid string, lang string")
    assert "".join(sorted(r["id"] for r in df.where(compile_where(tree, df.columns)).collect())) == want


def test_where_builder():
    assert build() is None and build("text") == {"type": "text"} and build("text", "1") == {"$and": [{"type": "text"}, {"pmid": "1"}]}
    assert build("text", "1", {"x": 2}) == {"x": 2} and both(None, {"a": 1}) == {"a": 1}
    with pytest.raises(ValueError, match="unknown filter operator"):
        compile_where({"year": {"$gt": 1}}, ["year"])


def test_bm25_ranks_rows_without_terms_too(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, ""), (4, "delta epsilon"), (5, "zeta eta")], "id long, text string").withColumn("seq", F.col("id"))
    got = R.write_index(df, str(tmp_path / "some")).top(["alpha", "none"], 5).orderBy("lex_rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5] and got[0]["score"] > 0 and got[1]["score"] == 0
    assert R.write_index(df.limit(0), str(tmp_path / "none")).top(["alpha"], 5).count() == 0


def test_an_index_moves_no_postings_and_a_question_no_counts(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).selectExpr("id", "id AS seq", "concat('alpha beta beta w', id, if(id % 4 = 0, ' even', '')) AS text", "id % 3 AS page")
    index = R.write_index(df, f"file://{tmp_path}/i", 2)
    files = index.blocks.select(F.explode("posts.id").alias("id"), F.input_file_name().alias("f")).distinct()
    assert files.count() == 40  # all postings of a row lie in one file
    counts = {r["id"]: (r["dl"], r["tfs"]) for r in index.forward.collect()}
    assert counts[4] == (5, {"alpha": 1, "beta": 2, "w4": 1, "even": 1}) and {r["term"]: r["df"] for r in index.terms.collect()}["even"] == 10
    plan = index.few_best(["even", "w4"], 3, F.col("page") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "tfs" not in plan
    assert [r["id"] for r in index.top(["even", "w4"], 3, F.col("page") == 1).orderBy("lex_rank").collect()] == [4, 16, 28]


def test_fusion_and_merge(spark):
    den = spark.createDataFrame([("a", 1), ("b", 2)], "id string, dense_rank long")
    lex = spark.createDataFrame([("b", 1), ("c", 2)], "id string, lex_rank long")
    assert [r["id"] for r in R.fuse(den, lex, 3).collect()] == ["b", "a", "c"]
    claims = spark.createDataFrame([("k", ["b", "zz"])], "id string, source_chunk_ids array<string>")
    hits = R.merge(claims.select("id"), den.select("id"), claims)
    assert sorted((r["section"], r["id"]) for r in hits.collect()) == [(0, "k"), (1, "a")]
    assert R.merge(claims.select("id"), den.select("id"), claims, skip_covered=False).count() == 3


def test_evaluation(spark):
    ranked = spark.createDataFrame([("s", 1, p, i) for i, p in enumerate(["9", "1", "1", None, "2"])] + [("s", 2, "9", 0)], "strategy string, qid int, pmid string, rank int")
    rel = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3"), (2, "1")], "qid int, pmid string")
    got = {r["qid"]: (r["hit"], r["recall"], r["mrr"]) for r in R.scores_of(ranked, rel).collect()}
    assert got == {1: (1, 0.666667, 0.5), 2: (0, 0.0, 0.0)}


def test_claim_checks(spark):
    rows = [("Up 42.5 percent", ["rose by 42.5 percent"], "increase", "Rose  BY"), ("x", ["y"], "sideways", "y"), ("x", ["y"], None, " "), ("x", ["y"], "n/a", "z"), ("has 17", ["has 117 and 170"], None, "has")]
    df = spark.createDataFrame(rows, "text string, src array<string>, direction string, span string")
    want = [None, "invalid_direction", "missing_evidence_span", "evidence_span_not_in_source", "numbers_not_in_source"]
    assert [r["error"] for r in C.validate(df).collect()] == want


def test_text_functions(spark):
    assert one(spark, X.slugify(F.lit("  Ünder the -- Sea! "))) == "nder-the-sea"
    assert one(spark, X.slugify(F.lit("!!"))) == "search"
    assert one(spark, X.year_of(F.lit("2019-03"))) == "2019" and one(spark, X.year_of(F.lit("Spring"))) == "Spring"
    assert one(spark, X.field_tag(F.lit('a "b"'), "T")) == "\"a 'b'\"[T]"
    assert one(spark, X.skipped_section(F.lit("Back > References"))) and not one(spark, X.skipped_section(F.lit("Reference values")))
    assert one(spark, X.tokenize(F.lit("Señor T-cell 2x"))) == ["se", "or", "t", "cell", "2x"]
    assert one(spark, X.html_text(F.lit("<p>a &lt; b</p><script>x</script>"))) == "a < b"


def test_cite_keys(spark):
    a = [{"family": "O'Neil", "given": "A"}]
    rows = [(i, a, "2020", "The of Rings") for i in range(3)] + [(9, [], None, None)]
    df = spark.createDataFrame(rows, "n int, authors array<struct<family:string,given:string>>, year string, title string")
    keyed = B.cite_keys(df, "n")
    assert [r["cite_key"] for r in keyed.orderBy("n").collect()] == ["oneil2020rings", "oneil2020ringsa", "oneil2020ringsb", "unknownnduntitled"]
    entry = keyed.where("n = 0").select(B.bibtex(keyed).alias("e")).first()["e"]
    assert entry == "@article{oneil2020rings,\n  author = {O'Neil, A},\n  title = {The of Rings},\n  year = {2020}\n}"


def test_cite_keys_go_on_past_one_byte(spark):
    df = spark.range(1, 301).selectExpr("id AS n", "array(named_struct('family', 'Ek', 'given', 'A')) AS authors", "'1999' AS year", "'Zinc' AS title")
    keys = {r["n"]: r["cite_key"] for r in B.cite_keys(df, "n").collect()}
    assert keys == {i: "ek1999zinc" + ("" if i == 1 else chr(95 + i)) for i in range(1, 301)}


def test_author_position(spark):
    f = lambda names: [{"family": n, "given": ""} for n in names]
    df = spark.createDataFrame([(f(["Roe"]),), (f(["X", "Roe"]),), (f(["X", "roe", "Y"]),), (f(["X"]),), (f([]),)], "authors array<struct<family:string,given:string>>")
    assert [r["p"] for r in df.select(B.author_position(F.col("authors"), "roe").alias("p")).collect()] == ["first", "last", "middle", None, None]


def test_tags(spark):
    t = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, L.tag_add(t, F.array(F.lit("c"), F.lit("a"), F.lit("c")))) == ["a", "b", "c", "c"]
    assert one(spark, L.tag_remove(t, F.array(F.lit("a")))) == ["b"]
    assert one(spark, L.tag_parse(F.lit(" x, ,y"))) == ["x", "y"]


def test_concepts():
    c = S.Concept("drug", ["MRI", "mri", "deep brain"])
    assert S.terms_of(c) == ["deep brain", "MRI"] and S.terms_of(c, "precise") == ["deep brain"] and S.terms_of(S.Concept("x", ["ab"]), "precise") == ["ab"]
    assert S.compile_query([c]) == '(("deep brain"[Title/Abstract] OR MRI[Title/Abstract])) AND English[Language]'
    assert S.select([S.Concept("o", ["x"], required=False)], "broad") and S.direct(" a\r\nb ") == "a b"
    for bad in (lambda: S.Concept(" ", ["x"]), lambda: S.Concept("x", [" "]), lambda: S.direct(" "), lambda: S.select([], "loose")):
        with pytest.raises(ValueError):
            bad()


def test_a_padded_word_is_a_short_word():
    assert S.terms_of(S.Concept("x", ["the ", "With"]), "precise") == ["the ", "With"]
    assert S.terms_of(S.Concept("x", ["the ", "of the"]), "precise") == ["of the"]


def test_nearest_caption(spark):
    fig = spark.createDataFrame([("d", 0, 5), ("e", 0, 1)], "doc string, figure int, page int")
    cap = spark.createDataFrame([("d", 4, 0, "before"), ("d", 6, 1, "after"), ("d", 6, 2, "later")], "doc string, page int, pos int, caption string")
    assert {r["doc"]: r["caption"] for r in P.nearest_caption(fig, cap).collect()} == {"d": "after", "e": None}


def test_articles_with_doctype_and_missing_parts(spark):
    xml = "<!DOCTYPE article SYSTEM 'x.dtd'><article><front><article-meta><title-group><article-title>A</article-title></title-group></article-meta></front></article>"
    r = P.jats_front(spark.createDataFrame([(1, xml)], "id int, xml string")).first()
    assert r["title"] == "A" and r["pmid"] is None and r["pages"] is None and r["authors"] == []


def test_captions_in_page_text(spark):
    text = "see Figure 1.\nFig. 2 | Two\nlines\n \nno\nFIGURE 3: three " + "x" * 600 + "\nFigure four. no"
    got = one(spark, P.caption_scan(F.lit(text)))
    assert got[0] == "Fig. 2 | Two lines" and got[1].startswith("FIGURE 3: three") and len(got[1]) == 500 and len(got) == 2
    assert one(spark, X.doi_of(F.lit("(doi 10.1000/ab.c).,"))) == "10.1000/ab.c"


def test_any_number_of_short_passages(spark, monkeypatch):
    from quillstone.operators import passages

    texts = ["alpha beta gamma", "ab", "a", "", "one two three four five six seven", "\U0001f600 x\ty", "alphabeta", None]
    asked = ["a", "ab", "alpha", "alpha beta", "beta gamm", "", "\U0001f600 x", "x\ty", "phabet", "none", "two three four five", "alphabeta ", "alpha  beta", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "qid long, asked string")
    want = sorted((d, q) for d, t in enumerate(texts) for q, a in enumerate(asked) if t is not None and a is not None and a in t)
    assert sorted(map(tuple, passages.holding(docs, items).collect())) == want
    monkeypatch.setattr(passages, "FEW", 2)
    assert sorted(map(tuple, passages.holding(docs, items).collect())) == want


def test_records_are_parsed_on_all_cores(spark):
    from quillstone.plans import registry

    assert registry.queries()["mesh_build"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_batch_of_questions_shuffles_neither_texts_nor_counts(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, i % 40, "claim" if i % 3 == 0 else "text", " ".join(rng.choices([f"w{j}" for j in range(25)], k=rng.randrange(1, 12)))) for i in range(600)]
    data += [(i, i % 7, "text", "w1 w2 w3 w4") for i in range(600, 900)]  # copies: seq and id decide
    rows = spark.createDataFrame(data, "id long, seq long, type string, text string").repartition(6)
    index = R.write_index(rows, str(tmp_path / "index"), kind=R.kind_of(F.col("type")))
    asked = spark.createDataFrame([(q, " ".join(rng.choices([f"w{j}" for j in range(27)], k=4))) for q in range(20)] + [(20, "w1 w2 w3 w4")], "qid long, text string")
    kinds = {"claims": [1], "chunks": [0], "mixed": None}
    got = index.batch(asked, kinds, 4)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan
    want = []
    for r in asked.collect():
        scored = index.scores(r["text"].split(" ")).join(index.forward, "id").collect()
        for s, c in kinds.items():
            own = sorted((-round(x["score"], 9), x["seq"], x["id"]) for x in scored if c is None or x["kind"] in c)[:4]
            want += [(s, r["qid"], i, -x, n + 1) for n, (x, _, i) in enumerate(own)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    from quillstone.operators import passages

    docs = spark.createDataFrame([(i, f"a b c d e {i} g h") for i in range(300)], "doc_id long, text string")
    found = passages.holding(docs, spark.createDataFrame([(1, "b c d e 7 g")], "qid long, asked string"))
    assert found.collect() == [(7, 1)] and "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_postings_of_a_row_are_counted_where_it_lies(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "A-a")], "id long, text string")
    got = R.postings(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["id", "term", "tf", "dl"] and sorted(map(tuple, got.collect())) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "a", 2, 2)]
    twice = R.postings(docs.unionByName(spark.createDataFrame([(1, "b c d")], docs.schema)))
    assert sorted(map(tuple, twice.collect())) == [(1, "a", 1, 3), (1, "b", 3, 3), (1, "c", 1, 3), (1, "d", 1, 3), (4, "a", 2, 2)]


def test_articles_are_made_and_parsed_once(spark):
    from quillstone.plans import registry

    read = registry.queries()["ingest_articles"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "documents.parquet" in f or "/articles-" in f]


def test_rows_are_counted_in_lots_of_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 5) + f"x{i % 3}") for i in range(60)] + [(60, "")], "id long, text string").coalesce(1)
    want = sorted((r["id"], r["dl"], sorted(r["tfs"].items())) for r in R.counted(docs).collect())
    monkeypatch.setattr(R, "WORDS", 7)
    assert sorted((r["id"], r["dl"], sorted(r["tfs"].items())) for r in R.counted(docs).collect()) == want and want[4] == (4, 5, [("w", 4), ("x1", 1)])
