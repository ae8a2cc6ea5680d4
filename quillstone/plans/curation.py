"""Queries of claim validation, triage and ingestion outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import claims as C
from quillstone.plans.registry import query
from quillstone.sources import tables as T

#: Claims with made-up fields, as the checks want them: direction, stated number and span by doc_id.
STATED = """, s AS (SELECT id, CAST(doc_key AS BIGINT) AS n, text || ' 42.5 of 17 and 9' AS text, [abstract || ' 17', coalesce(second, '')] AS src,
  CASE CAST(doc_key AS BIGINT) % 4 WHEN 0 THEN 'increase' WHEN 1 THEN 'sideways' WHEN 2 THEN ' N/A ' END AS direction,
  CASE CAST(doc_key AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'not in there' ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS span FROM claims)
"""


def stated(spark, d):
    n = F.col("doc_key").cast("long")
    direction = F.when(n % 4 == 0, "increase").when(n % 4 == 1, "sideways").when(n % 4 == 2, " N/A ")
    span = F.when(n % 5 == 0, "").when(n % 5 == 1, "not in there").otherwise(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return T.claims(spark, d).select("id", n.alias("n"), F.concat("text", F.lit(" 42.5 of 17 and 9")).alias("text"), F.array(F.concat("abstract", F.lit(" 17")), F.coalesce("second", F.lit(""))).alias("src"), direction.alias("direction"), span.alias("span"))


UNSET = "('', 'unknown', 'n/a', 'na', 'none', 'not reported', 'not stated')"
DIRECTION = f"CASE WHEN lower(trim(direction)) NOT IN {UNSET} THEN trim(direction) END"
FOUND = r"(trim(span) <> '' AND (contains(lower(regexp_replace(src[1], '\s+', ' ', 'g')), lower(trim(regexp_replace(span, '\s+', ' ', 'g')))) OR contains(lower(regexp_replace(src[2], '\s+', ' ', 'g')), lower(trim(regexp_replace(span, '\s+', ' ', 'g'))))))"
MISSING = "list_filter(list_filter(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: length(x) >= 2), lambda x: NOT regexp_matches(array_to_string(src, ' '), '(^|[^0-9.])' || replace(x, '.', '[.]') || '([^0-9]|$)'))"
query("structured_fields", STATED + f"SELECT id, {DIRECTION} AS direction FROM s", "claims")(lambda spark, d: stated(spark, d).select("id", X.structured(F.col("direction")).alias("direction")))
query("evidence_check", STATED + f"SELECT id, {FOUND} AS found FROM s", "claims")(lambda spark, d: stated(spark, d).select("id", X.span_in(F.col("span"), F.col("src")).alias("found")))
query("number_check", STATED + f"SELECT id, array_to_string({MISSING}, ' ') AS missing FROM s", "claims")(lambda spark, d: stated(spark, d).select("id", F.array_join(X.missing_numbers(F.col("text"), F.array_join("src", " ")), " ").alias("missing")))
query("claim_validate", STATED + f"SELECT id, CASE WHEN {DIRECTION} NOT IN ('increase', 'decrease', 'no_difference', 'mixed') THEN 'invalid_direction' WHEN trim(span) = '' THEN 'missing_evidence_span' WHEN NOT {FOUND} THEN 'evidence_span_not_in_source' WHEN len({MISSING}) > 0 AND n % 3 > 0 THEN 'numbers_not_in_source' END AS error FROM s", "claims")(
    lambda spark, d: C.validate(stated(spark, d), check_numbers=F.col("n") % 3 > 0).select("id", "error"))
query("claims_view", f"{STATED} SELECT direction, count(*) AS n FROM (SELECT {DIRECTION} AS direction FROM s) GROUP BY 1", "claims")(
    lambda spark, d: stated(spark, d).groupBy(X.structured(F.col("direction")).alias("direction")).agg(F.count("*").alias("n")))

# triage
query("triage_included", "SELECT pmid FROM triage WHERE included", "triage")(lambda spark, d: C.included_from_json(C.triage_json(T.triage(spark, d))))
query("triage_decisions", "SELECT pmid, included, CASE WHEN NOT included THEN reason END AS reason FROM triage", "triage")(lambda spark, d: T.triage(spark, d).select("pmid", "included", F.when(~F.col("included"), F.col("reason")).alias("reason")))
query("triage_summary", "SELECT count(*) AS total, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS excluded, count(*) FILTER (NOT included AND coalesce(reason, '') <> '') AS with_reason FROM triage", "triage")(lambda spark, d: C.triage_summary(T.triage(spark, d)))
query("triage_screen", "SELECT doc_key, title IS NOT NULL AND trim(title) <> '' AS kept FROM papers", "papers")(lambda spark, d: C.screen(T.papers(spark, d)).select("doc_key", "kept"))
query("triage_records", "SELECT doc_key, coalesce(nullif(title, ''), '(no title)') AS title, coalesce(array_to_string(list_transform(authors, lambda a: a.family), ', '), '') AS authors, coalesce(year, 'n.d.') AS year FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select("doc_key", F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)")).alias("title"), F.array_join(F.transform("authors", lambda a: a["family"]), ", ").alias("authors"), F.coalesce("year", F.lit("n.d.")).alias("year")))
query("triage_search", "SELECT doc_key FROM papers WHERE journal = 'BUILDING' AND year = '1996' AND contains(lower(coalesce(title, '') || ' ' || array_to_string(list_transform(authors, lambda a: a.family), ' ')), 'ring')", "papers")(
    lambda spark, d: C.search(T.papers(spark, d), "ring", journal="BUILDING", year="1996").select("doc_key"))
query("triage_to_ingest", "SELECT pmid, CASE WHEN CAST(pmid AS BIGINT) IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 'join' ELSE 'ingest' END AS action FROM triage WHERE included", "triage")(
    lambda spark, d: C.to_ingest(T.triage(spark, d), T.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_key"))))
query("ingest_outcomes", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'ingested' WHEN toxic = 1 THEN 'failed' ELSE 'skipped' END AS outcome FROM labels) GROUP BY 1")(
    lambda spark, d: T.triage(spark, d).groupBy(F.when(F.col("included"), "ingested").when(F.col("reason") == "toxic", "failed").otherwise("skipped").alias("outcome")).agg(F.count("*").alias("n")))
query("source_fallback", "SELECT d.doc_id, CASE WHEN a.doc_id IS NOT NULL THEN 'package' WHEN d.lang = 'en' THEN 'xml' WHEN d.n_chars > 2000 THEN 'pdf' ELSE 'metadata' END AS source, a.doc_id IS NOT NULL OR d.lang = 'en' OR d.n_chars > 2000 AS has_fulltext FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) a USING (doc_id)")(
    lambda spark, d: C.fallback(T.table(spark, d, "documents").join(T.table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("package").alias("pkg")), "doc_id", "left")
        .select("doc_id", "pkg", F.when(F.col("lang") == "en", "xml").alias("xml"), F.when(F.col("n_chars") > 2000, "pdf").alias("pdf"))))
query("search_info", "SELECT event_type AS label, count(*) AS n_searches, max(ts) AS last_at FROM events GROUP BY 1")(lambda spark, d: T.table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n_searches"), F.max("ts").alias("last_at")))
query("search_log", "SELECT strftime(ts, '%Y-%m-%d_%H%M%S') || '_' || event_type AS dir, CAST(json_extract(props, '$.k') AS BIGINT) AS total_count, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events")(
    lambda spark, d: T.table(spark, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd_HHmmss"), F.lit("_"), "event_type").alias("dir"), F.get_json_object("props", "$.k").cast("long").alias("total_count"), F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long").alias("place")))
