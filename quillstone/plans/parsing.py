"""Queries of parsing, chunking, captions and file naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import parsing as P
from quillstone.plans.registry import query
from quillstone.sources import tables as T


def docs(spark, d):
    return T.table(spark, d, "documents")


HTML = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"
query("html_to_text", rf"SELECT page_id, trim(regexp_replace({HTML}, '\s+', ' ', 'g')) AS text FROM pages")(lambda spark, d: T.table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("text")))
query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")(
    lambda spark, d: T.table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest")))
query("sha256", "SELECT page_id, sha256(html) AS digest FROM pages")(lambda spark, d: T.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest")))
query("infer_filename", r"SELECT page_id, CASE WHEN regexp_matches(n, '\.[A-Za-z0-9]{1,5}$') THEN n WHEN page_id % 3 = 0 THEN n || '.pdf' WHEN page_id % 3 = 1 THEN n || '.html' ELSE n || '.bin' END AS name FROM (SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/(?:.*/)?([^/]*)$', 1), ''), 'download') AS n FROM pages)")(
    lambda spark, d: T.table(spark, d, "pages").select("page_id", P.infer_filename(F.col("url"), F.when(F.col("page_id") % 3 == 0, "application/pdf").when(F.col("page_id") % 3 == 1, "text/html").otherwise("image/png")).alias("name")))
query("classify_target", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'url' WHEN page_id % 3 = 0 THEN 'pmid' ELSE 'path' END AS kind FROM pages")(
    lambda spark, d: T.table(spark, d, "pages").withColumn("t", F.when(F.col("page_id") % 2 == 0, F.col("url")).when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise(F.concat(F.lit("./"), F.col("page_id").cast("string"))))
        .select("page_id", F.when(F.col("t").rlike("^[0-9]+$"), "pmid").when(F.col("t").rlike("^(https?|ftp)://"), "url").otherwise("path").alias("kind")))
query("doi_extract", "SELECT doc_id, '10.1234/' || source || '.' || doc_id AS doi FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")(
    lambda spark, d: docs(spark, d).select("doc_id", X.doi_of(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see doi:10.1234/"), "source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".,; and on"))).otherwise(F.lit("none here"))).alias("doi")))
query("doi_to_pmid", "SELECT doi, min_by(page_id, pos) AS pmid FROM (SELECT '10.1/' || (page_id % 50) AS doi, page_id, 1000000 - page_id AS pos FROM pages) GROUP BY 1")(
    lambda spark, d: T.table(spark, d, "pages").groupBy(F.concat(F.lit("10.1/"), (F.col("page_id") % 50).cast("string")).alias("doi")).agg(F.min_by("page_id", 1000000 - F.col("page_id")).alias("pmid")))
query("latest_version", "SELECT article, max_by(article || '.' || v, v) AS prefix FROM (SELECT 'PMC' || (doc_id % 40) AS article, CAST(doc_id // 40 AS INT) AS v FROM documents) GROUP BY 1")(
    lambda spark, d: P.latest_version(docs(spark, d).select(F.concat(F.lit("PMC"), (F.col("doc_id") % 40).cast("string")).alias("article"), F.concat(F.lit("PMC"), (F.col("doc_id") % 40).cast("string"), F.lit("."), F.expr("doc_id div 40").cast("string")).alias("prefix"))))
query("package_keys", "SELECT doc_id, lang || doc_id || CASE doc_id % 4 WHEN 0 THEN '.xml' WHEN 1 THEN '.JPG' WHEN 2 THEN '_MOESM1.pdf' ELSE '.pdf' END AS key, CASE doc_id % 4 WHEN 0 THEN 'xml' WHEN 1 THEN 'image' ELSE 'pdf' END AS kind FROM documents WHERE doc_id % 4 <> 2")(
    lambda spark, d: docs(spark, d).withColumn("key", F.concat("lang", F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".xml", ".JPG", "_MOESM1.pdf", ".pdf"])), (F.col("doc_id") % 4 + 1).cast("int"))))
        .withColumn("kind", F.when(F.lower("key").endswith(".xml"), "xml").when(F.lower(F.substring_index("key", ".", -1)).isin(P.IMAGES), "image").when(F.lower("key").endswith(".pdf") & ~F.contains("key", F.lit("MOESM")), "pdf")).where("kind IS NOT NULL").select("doc_id", "key", "kind"))
query("skip_sections", "SELECT doc_id, doc_id % 3 <> 0 AS skipped FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", X.skipped_section(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Results > "), "lang", F.lit(" references"))).when(F.col("doc_id") % 3 == 1, "Back > References ").otherwise("reference")).alias("skipped")))
query("chunk_filter", "SELECT id FROM chunks WHERE tags <> 'src3' AND length(trim(text)) > 20", "chunks")(lambda spark, d: T.chunks(spark, d).withColumn("labels", F.array("tags")).where(~F.array_contains("labels", "src3") & (F.length(F.trim("text")) > 20)).select("id"))
query("heading_path", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source ELSE source END AS path, doc_id % 7 AS page FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", P.heading_path(F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit(None).cast("string"), F.col("source"))).alias("path"), F.get(F.filter(F.array(F.lit(None).cast("long"), F.col("doc_id") % 7), lambda p: p.isNotNull()), F.lit(0)).alias("page")))
query("max_tokens", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 8192 ELSE 512 END AS BIGINT) AS n FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", P.max_tokens(F.when(F.col("doc_id") % 2 == 0, "BAAI/bge-m3").otherwise(F.col("source"))).alias("n")))
query("chunk_documents", r"SELECT doc_id, CAST(floor(b / 200) AS BIGINT) AS chunk, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS b FROM (SELECT *, len(string_split_regex(text, ' +')) AS w FROM paras)) GROUP BY 1, 2", "paras")(
    lambda spark, d: P.chunk(T.paras(spark, d), 200).select("doc_id", "chunk", F.md5("text").alias("digest")))


def turns(spark, d, role):
    return T.table(spark, d, "conversations").where(F.col("role") == role)


NEAR = "SELECT f.conv_id AS doc, f.turn AS figure, arg_min(md5(c.text), (abs(c.turn - f.turn), CASE WHEN c.turn >= f.turn THEN 0 ELSE 1 END, c.turn)) AS caption FROM (SELECT * FROM conversations WHERE role = 'assistant') f LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') c USING (conv_id) GROUP BY 1, 2"


def nearest(spark, d):
    caps = turns(spark, d, "user").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("turn").alias("pos"), F.md5("text").alias("caption"))
    return P.nearest_caption(turns(spark, d, "assistant").select(F.col("conv_id").alias("doc"), F.col("turn").alias("figure"), F.col("turn").alias("page")), caps)


query("nearest_caption", NEAR)(nearest)
query("caption_backfill", f"SELECT doc, figure, CASE WHEN figure % 4 = 1 THEN 'Figure 1. kept' WHEN figure % 4 = 3 THEN NULL ELSE caption END AS caption FROM ({NEAR})")(
    lambda spark, d: nearest(spark, d).withColumn("linked", F.when(F.col("figure") % 4 == 1, "Figure 1. kept").when(F.col("figure") % 4 != 3, "see text"))
        .select("doc", "figure", F.when(F.col("linked").rlike(r"^(Figure|Fig\.?)\s+[0-9]+"), F.col("linked")).when(F.col("linked").isNotNull(), F.col("caption")).alias("caption")))
query("figure_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) > 200 AND turn % 4 <> 3")(
    lambda spark, d: turns(spark, d, "assistant").withColumns({"caption": F.when(F.length("text") > 200, F.col("text")), "image": F.when(F.col("turn") % 4 != 3, "img")}).where("caption IS NOT NULL AND image IS NOT NULL").select("conv_id", "turn"))
query("figure_rows", "SELECT conv_id || '::fig::' || turn AS id, coalesce(CASE WHEN turn % 4 = 1 THEN text END, 'Figure ' || (turn + 1) || ' (no caption)') AS text FROM conversations WHERE role = 'assistant'")(
    lambda spark, d: turns(spark, d, "assistant").select(F.concat(F.col("conv_id").cast("string"), F.lit("::fig::"), F.col("turn").cast("string")).alias("id"), F.coalesce(F.when(F.col("turn") % 4 == 1, F.col("text")), F.concat(F.lit("Figure "), (F.col("turn") + 1).cast("string"), F.lit(" (no caption)"))).alias("text")))
query("figure_captions", "SELECT conv_id, turn, string_split(text, chr(10))[1] AS caption FROM conversations WHERE role = 'user'")(lambda spark, d: turns(spark, d, "user").select("conv_id", "turn", F.regexp_extract_all(F.concat(F.lit("![Figure "), F.col("turn").cast("string"), F.lit("](p)\n\n"), F.split("text", "\n")[0], F.lit("\n\n")), F.lit(r"!\[Figure (\d+)\]\([^)]*\)\n\n([^\n]+)"), F.lit(2))[0].alias("caption")))
query("caption_scan", "SELECT conv_id, turn, trim(replace(split_part(substr('Figure ' || turn || '. ' || text || chr(10) || chr(10) || 'more', 1, 500), chr(10) || chr(10), 1), chr(10), ' ')) AS captions FROM conversations WHERE role = 'user'")(lambda spark, d: turns(spark, d, "user").select("conv_id", "turn", F.array_join(P.caption_scan(F.concat(F.lit("x\nFigure "), F.col("turn").cast("string"), F.lit(". "), "text", F.lit("\n\nmore"))), "|").alias("captions")))
query("bbox_json", "SELECT p_partkey, '{\"l\":' || p_size || '.0,\"t\":1.0,\"r\":' || (p_size + 2) || '.0,\"b\":3.5}' AS bbox FROM part")(
    lambda spark, d: T.table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").cast("double").alias("l"), F.lit(1.0).alias("t"), (F.col("p_size") + 2).cast("double").alias("r"), F.lit(3.5).alias("b"))).alias("bbox")))
query("unwrap_article", "SELECT doc_id, '<article a=\"1\"><p>' || lang || '</p></article>' AS article FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", P.unwrap_article(F.concat(F.lit('<?xml version="1.0"?><set><article a="1"><processing-meta x="1"><y/></processing-meta><p>'), "lang", F.lit("</p></article></set>"))).alias("article")))


def article(front: str):
    return F.concat(F.lit("<!DOCTYPE article PUBLIC 'x' 'y.dtd'><article><front><journal-meta><journal-title>J of "), "lang", F.lit("</journal-title></journal-meta><article-meta><article-id pub-id-type='pmid'>"), F.col("doc_id").cast("string"),
                    F.lit("</article-id><title-group><article-title><i>T</i> "), "source", F.lit("</article-title></title-group><contrib-group><contrib contrib-type='author'><name><surname>Roe</surname><given-names>Jo</given-names></name></contrib></contrib-group><pub-date><year>2019</year></pub-date><fpage>1</fpage><lpage>9</lpage></article-meta></front></article>"))


query("jats_front", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, 'J of ' || lang AS journal, 'T ' || source AS title, '2019' AS year, '1-9' AS pages, 'Roe' AS family FROM documents")(
    lambda spark, d: P.jats_front(docs(spark, d).select("doc_id", article("").alias("xml"))).select("doc_id", "pmid", "journal", "title", "year", "pages", F.get("authors", F.lit(0))["family"].alias("family")))
query("pubmed_record", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, 'About ' || source AS title, '1999' AS year FROM documents")(
    lambda spark, d: P.pubmed_record(docs(spark, d).select("doc_id", F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1999 Spring</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>About "), "source", F.lit("</ArticleTitle></Article></MedlineCitation></PubmedArticle>")).alias("xml"))).select("doc_id", "pmid", "title", "year"))
query("mesh_build", "SELECT p_partkey AS record, 'D' || p_partkey AS ui, p_name AS heading, unnest([p_name, p_type]) AS term FROM part")(
    lambda spark, d: P.mesh_terms(T.table(spark, d, "part", spread=True).select(F.col("p_partkey").alias("record"), F.concat(F.lit("<DescriptorRecord><DescriptorUI>D"), F.col("p_partkey").cast("string"), F.lit("</DescriptorUI><DescriptorName><String>"), "p_name", F.lit("</String></DescriptorName><ConceptList><Concept><TermList><Term><String>"), "p_name", F.lit("</String></Term><Term><String>"), "p_type", F.lit("</String></Term></TermList></Concept></ConceptList></DescriptorRecord>")).alias("xml"))))
query("file_info")(lambda spark, d: spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(d).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", X.human_mb(F.col("length")).alias("size")))
