"""Queries that bitmaps of rows answer: filters, facets under several filters, ranking under a filter, rows of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import bitmaps as B
from quillstone.plans.indexes import FIELDS, bitmaps_of, index_of
from quillstone.plans.registry import query
from quillstone.plans.retrieval import ASKED, ROWS

MEMBER = "doc_key IN (SELECT doc_key FROM members WHERE project = '{}')"
#: Each filter, and its condition in SQL.
FILTERS = {
    "all": (None, "true"),
    "claims": ({"type": "claim"}, "type = 'claim'"),
    "not_english": ({"section": {"$ne": "en"}}, "section <> 'en'"),
    "sources": ({"tags": {"$nin": ["src0", "src1"]}, "type": {"$in": ["text", "claim"]}}, "tags NOT IN ('src0', 'src1') AND type IN ('text', 'claim')"),
    "either": ({"$or": [{"type": "abstract"}, {"$and": [{"section": "es"}, {"page": {"$eq": 0}}]}]}, "type = 'abstract' OR (section = 'es' AND page = 0)"),
    "project": ({"project": {"$in": ["en", "fr"]}, "type": {"$ne": "claim"}}, f"({MEMBER.format('en')} OR {MEMBER.format('fr')}) AND type <> 'claim'"),
    "no_project": ({"project": {"$eq": None}}, "doc_key NOT IN (SELECT doc_key FROM members)"),
    "missing": ({"missing": {"$ne": "x"}, "section": "de"}, "section = 'de'"),
}

for _name, (_tree, _cond) in FILTERS.items():
    query(f"bitmap_{_name}", f"SELECT seq FROM rows_v WHERE {_cond}", "rows_v", "members")(
        lambda spark, d, t=_tree: B.keys(B.select(bitmaps_of(spark, d), t, FIELDS)).select(F.col("key").alias("seq")))

query("bitmap_facets", "".join([", r AS (SELECT *, ", ", ".join(f"{c} AS f_{n}" for n, (_, c) in FILTERS.items()), " FROM rows_v), v AS (SELECT *, unnest(['type', 'section', 'tags']) AS field, unnest([type, section, tags]) AS value FROM r)\n",
    " UNION ALL ".join(f"SELECT '{n}' AS filter, field, value, count(*) AS n FROM v WHERE f_{n} GROUP BY ALL" for n in FILTERS)]), "rows_v", "members")(
    lambda spark, d: B.facets(bitmaps_of(spark, d), {n: t for n, (t, _) in FILTERS.items()}, ["type", "section", "tags"], FIELDS))

for _name in ("not_english", "project"):
    query(f"bitmap_topk_{_name}", ROWS + f"SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, seq) AS lex_rank FROM sc WHERE {FILTERS[_name][1]} ORDER BY score DESC, seq LIMIT 20", "rows_v", "members")(
        lambda spark, d, t=FILTERS[_name][0]: index_of(spark, d, "rows").top(ASKED, 20, B.select(bitmaps_of(spark, d), t, FIELDS)).select("id", F.round("score", 6).alias("score"), "lex_rank"))
