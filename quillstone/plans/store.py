"""Queries of the row store: scans, row constructors, mutations, roll-ups, projects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import library as L
from quillstone.plans.registry import query
from quillstone.sources import tables as T

query("scan_rows", "SELECT id, type, doc_key FROM rows_v", "rows_v")(lambda spark, d: T.rows(spark, d).select("id", "type", "doc_key"))
query("scan_rows_where", "SELECT id, page FROM rows_v WHERE doc_key = '12' AND type = 'text'", "rows_v")(lambda spark, d: T.rows(spark, d).where("doc_key = '12' AND type = 'text'").select("id", "page"))
query("lookup_ids", "SELECT id, md5(text) AS digest FROM rows_v WHERE id IN ('3::abstract::0', '4::text::0', '4::text::1', 'none')", "rows_v")(
    lambda spark, d: L.lookup(T.rows(spark, d), ["3::abstract::0", "4::text::0", "4::text::1", "none"]).select("id", F.md5("text").alias("digest")))
query("row_ids", "SELECT id, doc_key, split_part(id, '::', 2) AS kind, CAST(split_part(id, '::', 3) AS BIGINT) AS n FROM rows_v", "rows_v")(
    lambda spark, d: T.rows(spark, d).select("id", "doc_key", F.split_part("id", F.lit("::"), F.lit(2)).alias("kind"), F.split_part("id", F.lit("::"), F.lit(3)).cast("long").alias("n")))
query("abstract_rows", "SELECT id, doc_key, md5(text) AS digest, tags FROM chunks WHERE type = 'abstract'", "chunks")(lambda spark, d: T.chunks(spark, d).where("type = 'abstract'").select("id", "doc_key", F.md5("text").alias("digest"), "tags"))
query("ingest_rows", "SELECT doc_key, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS chars, max(id) AS last_id FROM chunks GROUP BY 1", "chunks")(
    lambda spark, d: T.chunks(spark, d).groupBy("doc_key").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("chars"), F.max("id").alias("last_id")))


@query("hit_projection", "SELECT id, nullif(pmid, '') AS pmid, nullif(section, '') AS section, page, CASE WHEN type = 'claim' THEN text END AS evidence_span FROM rows_v", "rows_v")
def _(spark, d):
    none = F.lit("")
    return T.rows(spark, d).select("id", F.nullif("pmid", none).alias("pmid"), F.nullif("section", none).alias("section"), "page", F.when(F.col("type") == "claim", F.col("text")).alias("evidence_span"))


@query("sanitize", "SELECT doc_key, array_to_string(keywords, ', ') AS keywords, CAST(len(authors) AS VARCHAR) AS n_authors FROM papers WHERE len(keywords) > 0 UNION ALL SELECT doc_key, NULL, CAST(len(authors) AS VARCHAR) FROM papers WHERE len(keywords) = 0", "papers")
def _(spark, d):
    return T.papers(spark, d).select("doc_key", F.nullif(F.concat_ws(", ", "keywords"), F.lit("")).alias("keywords"), F.size("authors").cast("string").alias("n_authors"))


@query("claim_rows", "SELECT id, pmid, tags, section, array_to_string(source_chunk_ids, ', ') AS sources, md5(text) AS digest FROM claims", "claims")
def _(spark, d):
    return T.claims(spark, d).select("id", "pmid", "tags", "section", F.concat_ws(", ", "source_chunk_ids").alias("sources"), F.md5("text").alias("digest"))


# mutations: a second version of some rows arrives
NEW = "SELECT id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM rows_v WHERE type = 'abstract' UNION ALL SELECT 'new::text::' || doc_id, lang FROM documents"


def labelled(spark, d, rows, cond):
    """Rows of the documents whose label meets the condition."""
    return rows.join(T.table(spark, d, "labels").where(cond).select(F.col("doc_id").cast("string").alias("doc_key")), "doc_key", "left_semi")


def incoming(spark, d):
    fresh = T.table(spark, d, "documents").select(F.concat(F.lit("new::text::"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("text"))
    return T.rows(spark, d).where("type = 'abstract'").select("id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("text")).unionByName(fresh)


query("upsert_rows", f", nw AS ({NEW}) SELECT id, md5(text) AS digest FROM nw UNION ALL SELECT id, md5(text) FROM rows_v WHERE id NOT IN (SELECT id FROM nw)", "rows_v")(
    lambda spark, d: L.upsert(T.rows(spark, d).select("id", "text"), incoming(spark, d), "id").select("id", F.md5("text").alias("digest")))
query("delete_rows", "SELECT id FROM rows_v WHERE doc_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)", "rows_v")(
    lambda spark, d: L.delete(T.rows(spark, d), T.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_key")), "doc_key").select("id"))
query("replace_claims", """, x AS (SELECT * FROM claims WHERE doc_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 0))
SELECT id, type FROM rows_v WHERE NOT (type = 'claim' AND doc_key IN (SELECT doc_key FROM x)) UNION ALL SELECT doc_key || '::claim::1', 'claim' FROM x""", "rows_v")(
    lambda spark, d: L.replace(T.rows(spark, d).select("id", "doc_key", "type"), labelled(spark, d, T.claims(spark, d), "toxic = 0").select(F.concat("doc_key", F.lit("::claim::1")).alias("id"), "doc_key", F.lit("claim").alias("type")), "doc_key", F.col("type") == "claim").select("id", "type"))
query("force_reingest", """, x AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key FROM labels WHERE toxic = 1)
SELECT id FROM rows_v WHERE doc_key NOT IN (SELECT doc_key FROM x) UNION ALL SELECT id FROM chunks WHERE doc_key IN (SELECT doc_key FROM x)""", "rows_v")(
    lambda spark, d: L.replace(T.rows(spark, d).select("id", "doc_key"), labelled(spark, d, T.chunks(spark, d), "toxic = 1").select("id", "doc_key"), "doc_key").select("id"))
query("dedup_new", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda spark, d: T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id"))


@query("remove_report", "SELECT r AS ref, CASE WHEN CAST(doc_id AS VARCHAR) IS NULL THEN 'not_found' ELSE 'removed' END AS status FROM (SELECT CAST(doc_id * 3 AS VARCHAR) AS r FROM labels) LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = r")
def _(spark, d):
    asked = T.table(spark, d, "labels").select((F.col("doc_id") * 3).cast("string").alias("ref"))
    have = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key")).distinct()
    return asked.join(have, F.col("ref") == F.col("doc_key"), "left").select("ref", F.when(F.col("doc_key").isNull(), "not_found").otherwise("removed").alias("status"))


TAGS = "[source, lang]"
for _name, _f, _sql in (
    ("tag_set", lambda c: L.tag_set(F.array(F.lit("kept"), F.lit("read"))), "['kept', 'read']"),
    ("tag_add", lambda c: L.tag_add(c, F.array(F.lit("new"), F.lit("en"), F.lit("new"))), f"list_concat({TAGS}, list_filter(['new', 'en', 'new'], lambda x: NOT list_contains({TAGS}, x)))"),
    ("tag_remove", lambda c: L.tag_remove(c, F.array(F.lit("en"), F.lit("src0"))), f"list_filter({TAGS}, lambda x: x NOT IN ('en', 'src0'))"),
):
    query(_name, f"SELECT doc_id, array_to_string({_sql}, ',') AS tags FROM documents")(lambda spark, d, f=_f: T.table(spark, d, "documents").select("doc_id", F.array_join(f(F.array("source", "lang")), ",").alias("tags")))
query("tag_update", "SELECT id, CASE WHEN CAST(doc_key AS BIGINT) IN (SELECT doc_id FROM labels WHERE quality = 1) THEN tags || ', good' ELSE tags END AS tags FROM rows_v", "rows_v")(
    lambda spark, d: L.patch(T.rows(spark, d), T.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_key")).distinct(), "doc_key", "tags", F.concat("tags", F.lit(", good"))).select("id", "tags"))
query("tag_parse", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM conversations")(
    lambda spark, d: T.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(L.tag_parse(F.col("text")), "|").alias("tags")))
query("ordered_union", "SELECT doc_id, CASE WHEN lang = 'en' THEN source || ',en,x' ELSE source || ',' || lang || ',x,en' END AS u FROM documents")(
    lambda spark, d: T.table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(F.array("source", "lang"), F.array(F.lit("x"), F.lit("en")))), ",").alias("u")))

# roll-ups
query("embedded_counts", "SELECT doc_key, count(*) FILTER (type <> 'claim') AS n_chunks, count(*) FILTER (type = 'claim') AS n_claims FROM rows_v GROUP BY 1", "rows_v")(lambda spark, d: L.embedded_counts(T.rows(spark, d)))
STATUS = "SELECT doc_key, count(*) FILTER (type = 'claim') AS n_claims, count(*) FILTER (type IN ('text', 'abstract')) AS n_source_chunks, min_by(pmid, seq) AS pmid FROM rows_v GROUP BY 1 HAVING count(*) FILTER (type IN ('text', 'abstract')) > 0"
query("claims_status", STATUS, "rows_v")(lambda spark, d: L.claims_status(T.rows(spark, d)))
query("claims_status_missing", STATUS + " AND count(*) FILTER (type = 'claim') = 0", "rows_v")(lambda spark, d: L.claims_status(T.rows(spark, d), missing=True))
query("claims_by_doc", "SELECT doc_key, count(*) AS n, string_agg(id, ' ' ORDER BY CAST(split_part(id, '::', 3) AS BIGINT)) AS ids FROM (SELECT doc_key, id FROM claims UNION ALL SELECT doc_key, doc_key || '::claim::' || (page + 1) FROM chunks) GROUP BY 1", "claims", "chunks")(
    lambda spark, d: L.claims_by_doc(T.claims(spark, d).select("doc_key", "id").unionByName(T.chunks(spark, d).select("doc_key", F.concat("doc_key", F.lit("::claim::"), (F.col("page") + 1).cast("string")).alias("id")))))
query("claim_source_level", "SELECT id, CASE WHEN count(DISTINCT s.type) > 1 THEN 'mixed' WHEN max(s.type) = 'abstract' THEN 'abstract' ELSE 'fulltext' END AS level FROM (SELECT id, unnest(source_chunk_ids) AS sid FROM claims) c JOIN (SELECT id AS sid, type FROM chunks) s USING (sid) GROUP BY 1", "claims", "chunks")(
    lambda spark, d: L.source_level(T.claims(spark, d), T.chunks(spark, d)))
query("unknown_sources", "SELECT id, sid FROM (SELECT id, unnest(list_concat(source_chunk_ids, [doc_key || '::text::90'])) AS sid FROM claims) WHERE sid NOT IN (SELECT id FROM chunks)", "claims", "chunks")(
    lambda spark, d: L.unknown_sources(T.claims(spark, d).withColumn("source_chunk_ids", F.concat("source_chunk_ids", F.array(F.concat("doc_key", F.lit("::text::90"))))), T.chunks(spark, d)))
query("claims_with_page", "SELECT c.id, k.page FROM claims c LEFT JOIN chunks k ON k.id = c.source_chunk_ids[1]", "claims", "chunks")(
    lambda spark, d: T.claims(spark, d).select("id", F.col("source_chunk_ids")[0].alias("sid")).join(T.chunks(spark, d).select(F.col("id").alias("sid"), "page"), "sid", "left").select("id", "page"))
query("claims_chunks", "SELECT id, type, page, row_number() OVER (PARTITION BY doc_key ORDER BY type <> 'abstract', coalesce(page, 0), id) AS place FROM rows_v WHERE type IN ('text', 'abstract')", "rows_v")(
    lambda spark, d: T.rows(spark, d).where(F.col("type").isin("text", "abstract")).select("id", "type", "page", F.row_number().over(Window.partitionBy("doc_key").orderBy(F.col("type") != "abstract", F.coalesce("page", F.lit(0)), "id")).cast("long").alias("place")))
query("fulltext_md", "SELECT doc_key, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM chunks GROUP BY 1", "chunks")(
    lambda spark, d: T.chunks(spark, d).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("x")).select("doc_key", F.md5(F.array_join(F.transform("x", lambda r: r["text"]), "\n\n")).alias("digest")))
query("storage_summary", "SELECT lang, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(greatest(2, least(100, round_even(100.0 * sum(n_chars) / 300000, 0))) AS BIGINT) AS fill FROM documents GROUP BY 1")(lambda spark, d: L.storage(T.table(spark, d, "documents"), 300000))
query("human_mb", "SELECT doc_id, CASE WHEN n_chars * 500 / 1048576.0 < 0.1 THEN '< 0.1 MB' ELSE format('{:.1f} MB', n_chars * 500 / 1048576.0) END AS size FROM documents")(
    lambda spark, d: T.table(spark, d, "documents").select("doc_id", L.human_mb(F.col("n_chars") * 500).alias("size")))
query("dashboard_summary", "SELECT count(*) AS n_papers, count(*) FILTER (len(authors) > 0) AS n_fulltext, count(*) FILTER (len(keywords) > 3) AS with_figures FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).agg(F.count("*").alias("n_papers"), F.count_if(F.size("authors") > 0).alias("n_fulltext"), F.count_if(F.size("keywords") > 3).alias("with_figures")))
query("dashboard_rows", "SELECT p.doc_key, title, journal, year, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_claims, 0) AS n_claims, coalesce(n_chunks, 0) > 0 AS has_embedding FROM papers p LEFT JOIN (SELECT doc_key, count(*) FILTER (type <> 'claim') AS n_chunks, count(*) FILTER (type = 'claim') AS n_claims FROM rows_v GROUP BY 1) USING (doc_key)", "papers", "rows_v")(
    lambda spark, d: L.dashboard(T.papers(spark, d), L.embedded_counts(T.rows(spark, d))))

# projects
query("project_list", "SELECT project, count(*) AS n_members, coalesce(any_value(n), 0) AS n_searches FROM members LEFT JOIN (SELECT CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'de' ELSE 'xx' END AS project, count(*) AS n FROM events GROUP BY 1) USING (project) GROUP BY 1", "members")(
    lambda spark, d: L.project_list(T.members(spark, d), T.table(spark, d, "events").select(F.when(F.col("event_type") == "click", "en").when(F.col("event_type") == "view", "de").otherwise("xx").alias("project"))))
query("project_rows", "SELECT id FROM rows_v WHERE doc_key IN (SELECT doc_key FROM members WHERE project = 'en')", "rows_v", "members")(lambda spark, d: T.rows(spark, d).join(T.members(spark, d).where("project = 'en'"), "doc_key", "left_semi").select("id"))
query("sync_pruned", "SELECT project, doc_key FROM members WHERE doc_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)", "members")(
    lambda spark, d: L.pruned(T.members(spark, d), T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"))))
query("sync_no_chunks", "SELECT project, doc_key FROM members WHERE doc_key NOT IN (SELECT doc_key FROM chunks WHERE type = 'text')", "members", "chunks")(lambda spark, d: L.pruned(T.members(spark, d), T.chunks(spark, d).where("type = 'text'").select("doc_key")))
query("symlink_plan", "SELECT coalesce(m.doc_key, x.doc_key) AS doc_key, CASE WHEN x.doc_key IS NULL THEN 'link' WHEN m.doc_key IS NULL THEN 'unlink' ELSE 'keep' END AS action FROM (SELECT doc_key FROM members WHERE project = 'en') m FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_key FROM documents WHERE source IN ('src1', 'src2')) x ON m.doc_key = x.doc_key", "members")(
    lambda spark, d: L.link_plan(T.members(spark, d).where("project = 'en'").select("doc_key"), T.table(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").cast("string").alias("doc_key"))))
query("members_add", "SELECT coalesce(m.doc_key, x.doc_key) AS doc_key, m.doc_key IS NULL AS is_new, CASE WHEN m.doc_key IS NULL THEN 'search' WHEN x.doc_key IS NULL THEN 'manual' ELSE 'manual,search' END AS via FROM (SELECT doc_key FROM members WHERE project = 'en') m FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_key FROM documents WHERE source = 'src1') x ON m.doc_key = x.doc_key", "members")(
    lambda spark, d: L.add_members(T.members(spark, d).where("project = 'en'").select("doc_key", F.array(F.lit("manual")).alias("via")), T.table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").cast("string").alias("doc_key")), "search").withColumn("via", F.array_join("via", ",")))
query("members_remove", "SELECT ref, ref IN (SELECT doc_key FROM members WHERE project = 'en') AS was_member FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE source = 'src3')", "members")(
    lambda spark, d: L.membership(T.table(spark, d, "documents").where("source = 'src3'").select(F.col("doc_id").cast("string").alias("ref")).distinct(), T.members(spark, d).where("project = 'en'").select("doc_key")))
query("resolve_refs", "SELECT ref, coalesce(a.doc_key, b.doc_key) AS doc_key FROM (SELECT CAST(doc_id * 2 AS VARCHAR) AS ref FROM documents UNION ALL SELECT 'p' || doc_id FROM documents) LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_key FROM documents) a ON a.doc_key = ref LEFT JOIN (SELECT 'p' || doc_id AS pmid, CAST(doc_id AS VARCHAR) AS doc_key FROM documents) b ON b.pmid = ref")(
    lambda spark, d: L.resolve(T.table(spark, d, "documents").select((F.col("doc_id") * 2).cast("string").alias("ref")).unionAll(T.table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")))), T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("pmid"))))
