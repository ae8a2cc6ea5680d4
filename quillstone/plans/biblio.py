"""Queries over bibliographic records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import biblio as B
from quillstone.plans.registry import query
from quillstone.sources import tables as T

query("scan_papers", "SELECT doc_key, title, journal, year, CAST(len(authors) AS BIGINT) AS n_authors, array_to_string(keywords, '|') AS keywords FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select("doc_key", "title", "journal", "year", F.size("authors").cast("long").alias("n_authors"), F.array_join("keywords", "|").alias("keywords")))

NAME = "00000000"
POSITION = f"list_position(list_transform(authors, lambda a: contains(lower(a.family), '{NAME}')), true)"
POS = f"CASE WHEN {POSITION} = 1 THEN 'first' WHEN {POSITION} = len(authors) THEN 'last' WHEN {POSITION} > 1 THEN 'middle' END"
for _p, _cond in (("first", f"len(authors) > 0 AND contains(lower(authors[1].family), '{NAME}')"), ("last", f"len(authors) > 0 AND contains(lower(authors[-1].family), '{NAME}')"), ("any", f"{POSITION} > 0")):
    query(f"mine_author_{_p}", f"SELECT doc_key, {POS} AS position FROM papers WHERE {_cond}", "papers")(lambda spark, d, p=_p: B.mine(T.papers(spark, d), author=NAME, position=p).select("doc_key", "position"))
query("author_position", f"SELECT doc_key, {POS} AS position FROM papers", "papers")(lambda spark, d: T.papers(spark, d).select("doc_key", B.author_position(F.col("authors"), NAME).alias("position")))
for _n, _kw, _cond in (("mine_year", {"year": "1995-1997"}, "CAST(year AS INT) BETWEEN 1995 AND 1997"), ("mine_journal", {"journal": "Mach"}, "contains(lower(journal), 'mach')"), ("mine_keyword", {"keyword": "promo"}, "len(list_filter(keywords, lambda k: contains(lower(k), 'promo'))) > 0"), ("mine_pubtype", {"pub_type": "urgent"}, "contains(lower(pub_types[1]), 'urgent')")):
    query(_n, f"SELECT doc_key, year, journal FROM papers WHERE {_cond}", "papers")(lambda spark, d, kw=_kw: B.mine(T.papers(spark, d), **kw).select("doc_key", "year", "journal"))
query("mine_project", f"SELECT doc_key, title, journal, year, {POS} AS position FROM papers WHERE {POSITION} > 0 AND CAST(year AS INT) = 1996 AND contains(lower(journal), 'house')", "papers")(
    lambda spark, d: B.mine(T.papers(spark, d), author=NAME, year="1996", journal="house").select("doc_key", "title", "journal", "year", "position"))

BASE = """, b AS (SELECT *, coalesce(nullif(regexp_replace(lower(coalesce(authors[1].family, '')), '[^a-z0-9]', '', 'g'), ''), 'unknown') || coalesce(year, 'nd') ||
  coalesce(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'in', 'on', 'and', 'for', 'to', 'with', 'is', 'as'))[1], regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')[1], 'untitled') AS base FROM papers),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n) AS i FROM b), c AS (SELECT *, base || CASE WHEN i = 1 THEN '' ELSE chr(CAST(95 + i AS INT)) END AS cite_key FROM k)
"""
query("cite_keys", BASE + "SELECT doc_key, base, cite_key FROM c", "papers")(lambda spark, d: B.cite_keys(T.papers(spark, d), "n").select("doc_key", "base", "cite_key"))
query("cite_bibtex", BASE + """SELECT doc_key, '@article{' || cite_key || ',' || chr(10) || concat_ws(',' || chr(10),
  CASE WHEN len(authors) > 0 THEN '  author = {' || array_to_string(list_transform(authors, lambda a: a.family || ', ' || a.given), ' and ') || '}' END,
  '  title = {' || title || '}', '  journal = {' || journal || '}', '  year = {' || year || '}', '  volume = {' || volume || '}') || chr(10) || '}' AS entry FROM c""", "papers")(
    lambda spark, d: (k := B.cite_keys(T.papers(spark, d), "n")).select("doc_key", B.bibtex(k).alias("entry")))
NAMES = "list_transform(authors, lambda a: a.family)"
query("authors_summary", f"SELECT doc_key, CASE WHEN len(authors) > 3 THEN array_to_string({NAMES}[1:3], ', ') || ' et al.' ELSE array_to_string({NAMES}, ', ') END AS authors FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select("doc_key", B.authors_summary(F.col("authors")).alias("authors")))
query("last_author", "SELECT doc_key, authors[-1].family AS family FROM papers", "papers")(lambda spark, d: T.papers(spark, d).select("doc_key", B.last_author(F.col("authors")).alias("family")))
query("author_initials", "SELECT doc_key, array_to_string(list_transform(authors, lambda a: trim(a.family || ' ' || array_to_string(list_transform(string_split(a.given, ' '), lambda w: substr(w, 1, 1)), ''))), ', ') AS authors FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select("doc_key", B.initials(F.col("authors")).alias("authors")))
query("year_normalize", "SELECT o_orderkey, coalesce(nullif(regexp_extract(v, '^([0-9]{4})', 1), ''), v) AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m') END AS v FROM orders)")(
    lambda spark, d: T.table(spark, d, "orders").select("o_orderkey", X.year_of(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))).alias("year")))
query("year_histogram", "SELECT year, count(*) AS n FROM papers GROUP BY 1", "papers")(lambda spark, d: T.papers(spark, d).groupBy("year").agg(F.count("*").alias("n")))
query("facet_values", "SELECT DISTINCT 'journal' AS facet, journal AS value FROM papers UNION SELECT DISTINCT 'year', year FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select(F.explode(F.array(F.struct(F.lit("journal").alias("facet"), F.col("journal").alias("value")), F.struct(F.lit("year").alias("facet"), F.col("year").alias("value")))).alias("x")).select("x.facet", "x.value").where("value <> ''").distinct())
query("keyword_dedupe", "SELECT o_orderkey, w, pos FROM (SELECT o_orderkey, w, i - 1 AS pos, row_number() OVER (PARTITION BY o_orderkey, lower(w) ORDER BY i) AS r FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority || ' ' || lower(o_orderpriority) || ' x X', ' ')) AS w, generate_subscripts(string_split(o_orderpriority || ' ' || lower(o_orderpriority) || ' x X', ' '), 1) AS i FROM orders)) WHERE r = 1")(
    lambda spark, d: T.first_seen(T.table(spark, d, "orders").select("o_orderkey", F.posexplode(F.split(F.concat("o_orderpriority", F.lit(" "), F.lower("o_orderpriority"), F.lit(" x X")), " ")).alias("pos", "w")).withColumn("_k", F.struct("o_orderkey", F.lower("w"))), "_k", "pos").select("o_orderkey", "w", F.col("pos").cast("long").alias("pos")))
query("dedupe_first_seen", "SELECT user_id, min_by(event_id, ts) AS event_id FROM events GROUP BY 1")(
    lambda spark, d: T.first_seen(T.table(spark, d, "events"), "user_id", "ts").select("user_id", "event_id"))
query("reference_string", "SELECT doc_key, concat_ws(' ', CASE WHEN len(authors) > 0 THEN rtrim(array_to_string(list_transform(authors, lambda a: a.family || ' ' || a.given), ', '), ',.') || '.' END, CASE WHEN title IS NOT NULL THEN rtrim(title, '.') || '.' END, journal, volume, '(' || year || ').') AS ref FROM papers", "papers")(
    lambda spark, d: T.papers(spark, d).select("doc_key", F.concat_ws(" ",
        F.when(F.size("authors") > 0, F.concat(F.rtrim(F.array_join(F.transform("authors", lambda a: F.concat(a["family"], F.lit(" "), a["given"])), ", "), F.lit(",.")), F.lit("."))),
        F.concat(F.rtrim("title", F.lit(".")), F.lit(".")), "journal", "volume", F.concat(F.lit("("), "year", F.lit(").")))
        .alias("ref")))
