"""Queries that positional postings answer: phrases, Boolean searches of phrases, their funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import positions as P
from quillstone.operators import search as S
from quillstone.plans.indexes import positions_of
from quillstone.plans.registry import query

CONCEPTS = [S.Concept("article", ["the", "With", "with"]), S.Concept("stem", ["of the", "in the", "end"]), S.Concept("extra", ["a small", "for a"], required=False)]
PHRASES = ["of the", "the", "in the end", "Of, the", "one of the", "no such phrase at all", "--"]

WORDS = ", d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), j AS (SELECT doc_id, lang, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d)\n"


def either(*terms: str) -> str:
    return "(" + " OR ".join(f"contains(t, ' {x} ')" for x in terms) + ")"


ARTICLE, STEM, EXTRA = either("the", "with"), either("of the", "in the", "end"), either("a small", "for a")
for _n, _s, _cond in (("phrase_concepts", "balanced", f"{ARTICLE} AND {STEM} AND {EXTRA}"), ("phrase_broad", "broad", f"{ARTICLE} AND {STEM}"), ("phrase_precise", "precise", f"{ARTICLE} AND {either('of the', 'in the')} AND {EXTRA}")):
    query(_n, WORDS + f"SELECT doc_id FROM j WHERE lang = 'en' AND {_cond}")(lambda spark, d, s=_s: P.matching(positions_of(spark, d), CONCEPTS, s).select(F.col("id").alias("doc_id")))

query("phrase_funnel", WORDS + f"""SELECT unnest([1, 2, 3])::BIGINT AS step, unnest(['article', 'stem', 'extra']) AS concept,
unnest([count(*) FILTER ({ARTICLE}), count(*) FILTER ({ARTICLE} AND {STEM}), count(*) FILTER ({ARTICLE} AND {STEM} AND {EXTRA})]) AS total_count FROM j WHERE lang = 'en'""")(
    lambda spark, d: P.funnel(positions_of(spark, d), CONCEPTS))

query("phrase_places", WORDS + f""", p AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9]+') AS q FROM (SELECT unnest({PHRASES}) AS phrase)),
f AS (SELECT phrase, doc_id, list_filter(range(len(w)), lambda i: w[i + 1 : i + len(q)] = q) AS k FROM d, p WHERE len(q) > 0)
SELECT phrase, doc_id, CAST(len(k) AS BIGINT) AS n, CAST(k[1] AS BIGINT) AS first_place, CAST(k[-1] AS BIGINT) AS last_place FROM f WHERE len(k) > 0""")(
    lambda spark, d: P.holding(positions_of(spark, d), spark.createDataFrame([(p, p) for p in PHRASES], "key string, phrase string")).select(
        "phrase", F.col("id").alias("doc_id"), F.size("places").cast("long").alias("n"), F.get("places", F.lit(0)).cast("long").alias("first_place"), F.element_at("places", -1).cast("long").alias("last_place")))
