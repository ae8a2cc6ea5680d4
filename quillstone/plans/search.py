"""Queries of the Boolean compiler, heading lookup and result paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import search as S
from quillstone.plans.registry import query
from quillstone.sources import tables as T

CONCEPTS = [S.Concept("article", ["the ", "With", "with"]), S.Concept("stem", ["errent", "of the", "ha"]), S.Concept("extra", ["pathetic", "stupid loser"], required=False)]
HAS = {"article": "(contains(lower(text), 'the ') OR contains(lower(text), 'with'))", "stem": "(contains(lower(text), 'errent') OR contains(lower(text), 'of the') OR contains(lower(text), 'ha'))", "extra": "(contains(lower(text), 'pathetic') OR contains(lower(text), 'stupid loser'))"}
PRECISE = "(contains(lower(text), 'errent') OR contains(lower(text), 'of the'))"
EXACT = "contains(lower(text), 'the ') OR contains(lower(text), 'with')"


def docs(spark, d):
    return T.table(spark, d, "documents")


for _n, _s, _cond in (("concept_query", "balanced", " AND ".join(HAS.values())), ("sensitivity_broad", "broad", f"{HAS['article']} AND {HAS['stem']}"), ("sensitivity_precise", "precise", f"({EXACT}) AND {PRECISE} AND {HAS['extra']}")):
    query(_n, f"SELECT doc_id FROM documents WHERE lang = 'en' AND {_cond}")(lambda spark, d, s=_s: S.matching(docs(spark, d), CONCEPTS, s).select("doc_id"))

FUNNEL = f""", f AS (SELECT unnest([1, 2, 3])::BIGINT AS step, unnest(['article', 'stem', 'extra']) AS concept, unnest([
  count(*) FILTER ({HAS['article']}), count(*) FILTER ({HAS['article']} AND {HAS['stem']}), count(*) FILTER ({' AND '.join(HAS.values())})]) AS total_count FROM documents WHERE lang = 'en')
"""
query("search_funnel", FUNNEL + "SELECT * FROM f")(lambda spark, d: S.funnel(docs(spark, d), CONCEPTS))
query("funnel_excluded", FUNNEL + "SELECT *, total_count - lead(total_count) OVER (ORDER BY step) AS excluded FROM f")(lambda spark, d: S.excluded(S.funnel(docs(spark, d), CONCEPTS)))
query("field_tag", "SELECT conv_id, turn, CASE WHEN contains(t, ' ') THEN '\"' || t || '\"[Title/Abstract]' ELSE t || '[Title/Abstract]' END AS tagged FROM (SELECT conv_id, turn, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\"', '''') AS t FROM conversations)")(
    lambda spark, d: T.table(spark, d, "conversations").select("conv_id", "turn", X.field_tag(F.col("text"), "Title/Abstract").alias("tagged")))
query("direct_query", "SELECT conv_id, turn, md5(replace(replace(replace(trim(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), ' ')) AS digest FROM conversations")(
    lambda spark, d: T.table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(F.trim("text"), "\r\n|\r|\n", " ")).alias("digest")))
query("slugify", "SELECT conv_id, turn, coalesce(nullif(trim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-'), ''), 'search') AS slug FROM conversations")(
    lambda spark, d: T.table(spark, d, "conversations").select("conv_id", "turn", X.slugify(F.col("text")).alias("slug")))
query("esearch_pages", "SELECT CAST(user_id AS VARCHAR) AS pmid, row_number() OVER (ORDER BY min(event_id)) - 1 AS pos FROM events GROUP BY 1 ORDER BY 2 LIMIT 500")(
    lambda spark, d: S.pages_merged(T.table(spark, d, "events").select(F.col("user_id").cast("string").alias("pmid"), F.col("event_id").alias("pos")), 500))
query("search_truncated", "SELECT event_type, count(*) AS total, least(count(*), 1000, 10000) AS returned, count(*) > 1000 AS truncated FROM events GROUP BY 1")(
    lambda spark, d: T.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total")).withColumns({"returned": F.least("total", F.lit(1000), F.lit(S.MOST_RESULTS)), "truncated": F.col("total") > 1000}))
HEAD = ", h AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS term, min_by(p_type, p_partkey) AS heading FROM part GROUP BY 1) "


def headings(spark, d):
    return S.heading_table(T.table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("heading"), F.col("p_partkey").alias("record")))


def brands(spark, d):
    """A concept of each brand: its parts' names and their first words."""
    terms = F.array_sort(F.array_distinct(F.concat(F.collect_list("p_name"), F.collect_list(F.substring_index("p_name", " ", 1)))))
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("concept")).agg((F.max("p_size") % 2 == 0).alias("expand"), terms.alias("terms"))


query("compile_clauses", """, c AS (SELECT p_brand AS concept, max(p_size) % 2 = 0 AS expand, list_sort(list_distinct(list(p_name) || list(split_part(p_name, ' ', 1)))) AS terms FROM part GROUP BY 1),
h AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS term, min_by(p_type, p_partkey) AS heading FROM part GROUP BY 1),
f AS (SELECT concept, list_sort(list_distinct(list(heading))) AS heads FROM (SELECT concept, unnest(terms) AS t FROM c WHERE expand) JOIN h ON h.term = lower(t) GROUP BY 1),
t AS (SELECT concept, list_transform(list_filter(terms, lambda x: contains(x, ' ') OR length(x) > 4), lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END || '[Title/Abstract]')
  AS terms FROM c)
SELECT concept, '(' || array_to_string(coalesce(list_transform(heads, lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END || '[MeSH Terms]'), []) || terms, ' OR ') || ')' AS clause FROM t LEFT JOIN f USING (concept)""")(
    lambda spark, d: S.clause_rows(brands(spark, d), headings(spark, d), "precise"))
query("mesh_first_wins", HEAD + "SELECT * FROM h")(lambda spark, d: headings(spark, d))
query("mesh_lookup", HEAD + "SELECT p_partkey, heading FROM part LEFT JOIN h ON lower(p_name) = h.term AND p_partkey % 3 > 0")(
    lambda spark, d: S.look_up(T.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.concat(F.upper("p_name"), F.lit("  "))).otherwise("?").alias("term")), headings(spark, d)).select("p_partkey", "heading"))
