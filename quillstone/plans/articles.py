"""Queries of articles in XML, chunks under headings, and the dashboard's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.library import DEFAULT_MODEL
from quillstone.operators import articles as A
from quillstone.operators import html as H
from quillstone.operators import library as L
from quillstone.operators.token_chunks import token_chunks
from quillstone.plans.indexes import indexed
from quillstone.plans.registry import query
from quillstone.sources import tables as T
from quillstone.sources.versions import stored

#: Chunks ``c`` (doc_key, run, part, heading, text) of paragraphs ``b`` (doc_key, pos, heading, w) for DuckDB, half of a chunk's words at a time.
CHUNKED = r""", p AS (SELECT doc_key, pos, heading, k, list_slice(w, k * {half} + 1, k * {half} + {half}) AS w FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / {half}.0) AS BIGINT))) AS k FROM b WHERE len(w) > 0)),
r AS (SELECT *, CASE WHEN lag(heading) OVER o IS DISTINCT FROM heading THEN 1 ELSE 0 END AS n FROM p WINDOW o AS (PARTITION BY doc_key ORDER BY pos, k)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_key ORDER BY pos, k) AS run FROM r),
t AS (SELECT *, CAST(sum(len(w)) OVER (PARTITION BY doc_key, run ORDER BY pos, k) - len(w) AS BIGINT) // {half} AS part FROM s),
c AS (SELECT doc_key, run, part, heading, ltrim(string_agg(CASE WHEN k > 0 THEN ' ' ELSE chr(10) END || array_to_string(w, ' '), '' ORDER BY pos, k), ' ' || chr(10)) AS text FROM t GROUP BY ALL)
"""
SECTIONS = r""", b AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_key, pos, CASE WHEN pos % 9 = 8 THEN 'References' ELSE source || ' > Part ' || (pos // 4) END AS heading, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM paras) WHERE heading <> 'References')"""


def headed(spark, d):
    """Paragraphs of documents under headings, some of them reference lists."""
    heading = F.when(F.col("pos") % 9 == 8, "References").otherwise(F.concat("source", F.lit(" > Part "), F.expr("cast(pos div 4 AS string)")))
    return T.paras(spark, d).select(F.col("doc_id").cast("string").alias("doc_key"), "pos", F.lit("text").alias("kind"), heading.alias("heading"), "text")


@query("section_chunks", SECTIONS + CHUNKED.format(half=60) + "SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY run, part) - 1 AS chunk, heading, md5(replace(heading, ' > ', chr(10)) || chr(10) || text) AS digest FROM c", "paras")
def _(spark, d):
    return A.section_chunks(headed(spark, d), 120).select("doc_key", "chunk", "heading", F.md5("text").alias("digest"))


@query("token_chunks")
def _(spark, d):
    """Chunks of all documents by tokens of a byte-level vocabulary; SQL can't encode, so tests hold them against one-by-one packing and an independent count."""
    import public_tokenizers

    return token_chunks(headed(spark, d), public_tokenizers.path("byte_bpe_50k.json"), 128).select("doc_key", "chunk", "heading", "tokens", F.md5("text").alias("digest"))


def articles(spark, d):
    """Documents as articles: a paragraph for each line, of letters, digits and dots."""
    text = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .\n]", " "), F.lit("\n"), F.lit("</p><p>"))
    key = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<!DOCTYPE article PUBLIC 'x' 'y.dtd'><set><article><front><article-meta><article-id pub-id-type='pmid'>"), key, F.lit("</article-id><title-group><article-title>About <i>"), "source",
        F.lit("</i></article-title></title-group><abstract><p>In "), "lang", F.lit("</p></abstract></article-meta></front><body><sec><title>Intro</title><p>"), text,
        F.lit("</p><fig><label>Figure 1.</label><caption><p>From "), "source", F.lit("</p></caption></fig></sec><sec><title>References</title><p>none</p></sec></body></article></set>"),
    )
    return A.sound(T.table(spark, d, "documents").select(key.alias("doc_key"), xml.alias("xml")))


LINES = r""", b AS (SELECT doc_key, pos, 'Intro' AS heading, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM (
  SELECT CAST(doc_id AS VARCHAR) AS doc_key, unnest(k) AS t, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .\n]', ' ', 'g'), chr(10)) AS k FROM documents)))"""
ARTICLE_ROWS = LINES + CHUNKED.format(half=A.words_for(DEFAULT_MODEL) // 2) + """, u AS (
SELECT doc_key, 'text::' || (row_number() OVER (PARTITION BY doc_key ORDER BY run, part) - 1) AS x, 'text' AS type, heading AS section, md5(heading || chr(10) || text) AS digest FROM c
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'fig::0', 'figure', 'Intro', md5('Figure 1. From ' || source) FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'abstract::0', 'abstract', NULL, md5('In ' || lang) FROM documents)
SELECT doc_key || '::' || x AS id, doc_key, doc_key AS pmid, 'About ' || source AS title, type, section, digest FROM u JOIN documents ON CAST(doc_id AS VARCHAR) = doc_key"""


@query("ingest_articles", ARTICLE_ROWS)
def _(spark, d):
    own = stored(articles(spark, d), "articles")  # read for blocks and, three times, for records; these twice each
    blocks, papers = stored(A.blocks(own), "blocks"), stored(A.records(own), "papers")
    return A.library_rows(blocks, papers, DEFAULT_MODEL).select("id", "doc_key", "pmid", "title", "type", "section", F.md5("text").alias("digest"))


@query("page_chunks")
def _(spark, d):
    """Chunks of all pages; SQL can't keep a stack of elements, so tests hold blocks of pages against those written down."""
    pages = T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_key"), "html")
    return A.section_chunks(H.blocks(pages), 120).select("doc_key", "chunk", "heading", F.md5("text").alias("digest"))


@query("dashboard_full", """, f AS (SELECT CAST(conv_id AS VARCHAR) AS doc_key, count(*) AS n, string_agg(text, '|' ORDER BY turn, text) AS captions FROM conversations WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT doc_key, count(*) FILTER (type <> 'claim') AS n, count(*) FILTER (type = 'claim') AS m, string_agg(id, '|' ORDER BY id) FILTER (type = 'claim') AS ids FROM rows_v GROUP BY 1),
a AS (SELECT doc_key, list_filter(list_transform(authors, lambda x: x.family), lambda x: x <> '') AS names FROM papers),
h AS (SELECT CAST(doc_id AS VARCHAR) AS doc_key, doc_id % 3 AS kind, n_chars * 500 / 1048576.0 AS mb FROM documents)
SELECT p.doc_key, p.title, coalesce(CASE WHEN len(names) > 3 THEN array_to_string(names[1:3], ', ') || ' et al.' ELSE array_to_string(names, ', ') END, '') AS authors, names[-1] AS last_author, journal, year, volume,
  array_to_string(keywords, ';') AS keywords, array_to_string(pub_types, ';') AS pub_types, coalesce(kind = 0, false) AS has_pdf, CASE WHEN kind = 0 THEN CASE WHEN mb < 0.1 THEN '< 0.1 MB' ELSE format('{:.1f} MB', mb) END END AS pdf_size,
  coalesce(kind = 1, false) AS has_xml, coalesce(kind = 2, false) AS has_html, coalesce(f.n, 0) AS n_figures, CASE WHEN f.n > 0 THEN 'figs/' || p.doc_key || '.png' END AS cover, md5(coalesce(captions, '')) AS captions,
  coalesce(e.n, 0) + coalesce(f.n, 0) AS n_chunks, coalesce(e.n, 0) + coalesce(f.n, 0) > 0 AS has_embedding, coalesce(m, 0) AS n_claims, coalesce(ids, '') AS claims, CASE WHEN m > 0 THEN CAST(0 AS BIGINT) END AS page
FROM papers p JOIN a USING (doc_key) LEFT JOIN f USING (doc_key) LEFT JOIN e USING (doc_key) LEFT JOIN h USING (doc_key)""", "rows_v", "papers")
def _(spark, d):
    own = indexed(spark, d, "rows")
    talk = T.table(spark, d, "conversations").where("role = 'assistant'")
    key = F.col("conv_id").cast("string")
    figures = talk.select(F.concat(key, F.lit("::fig::"), F.col("turn").cast("string")).alias("id"), key.alias("doc_key"), F.lit("figure").alias("type"), "text")
    name = F.element_at(F.array(*map(F.lit, L.PAGED)), (F.col("doc_id") % 3 + 1).cast("int"))
    files = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), name.alias("name"), (F.col("n_chars") * 500).alias("length"))
    got = L.paper_rows(T.papers(spark, d), own.unionByName(figures, allowMissingColumns=True), files)
    listed = lambda c, by: F.array_join(c, by)
    return got.select(
        "doc_key", "title", "authors", "last_author", "journal", "year", "volume", listed("keywords", ";").alias("keywords"), listed("pub_types", ";").alias("pub_types"), "has_pdf", "pdf_size", "has_xml", "has_html",
        "n_figures", "cover", F.md5(listed("figure_captions", "|")).alias("captions"), "n_chunks", "has_embedding", "n_claims", listed(F.transform("claims", lambda c: c["id"]), "|").alias("claims"), F.get("claims", F.lit(0))["page"].alias("page"),
    )
