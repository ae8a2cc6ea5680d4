"""Queries of files: records that may be broken, figures, sizes and lists of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans.registry import query
from quillstone.sources import files as S
from quillstone.sources import tables as T

RAW = """'{"title": "' || coalesce(text, '') || '", "lang": "' || lang || '"}'"""


@query("scan_records", f"SELECT doc_id, json ->> '$.lang' AS lang, md5(json ->> '$.title') AS title FROM (SELECT doc_id, {RAW} AS json FROM documents) WHERE json_valid(json)")
def _(spark, d):
    raw = F.concat(F.lit('{"title": "'), F.coalesce("text", F.lit("")), F.lit('", "lang": "'), "lang", F.lit('"}'))
    found = S.records(T.table(spark, d, "documents").select("doc_id", raw.alias("json")), "title string, lang string")
    return found.select("doc_id", "record.lang", F.md5("record.title").alias("title"))


@query("figure_files", "SELECT CAST(conv_id AS VARCHAR) AS doc_key, string_agg('figs/fig_' || turn || '.png', '|' ORDER BY turn) AS figures FROM conversations WHERE role = 'assistant' GROUP BY 1")
def _(spark, d):
    name = F.concat(F.lit("figs/fig_"), F.col("turn").cast("string"), F.when(F.col("role") == "assistant", ".png").otherwise(".txt"))
    own = T.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_key"), name.alias("path"))
    return S.figure_files(own).select("doc_key", F.array_join("figures", "|").alias("figures"))


@query("folder_sizes", "SELECT 'home/' || source || '/' || lang AS folder, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS length FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL")
def _(spark, d):
    path = F.concat(F.lit("home/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return S.folder_sizes(T.table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("length")).where("path IS NOT NULL"))


@query("id_lists", r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, md5(id) AS id FROM (
SELECT doc_id, id, min(pos) AS pos FROM (SELECT doc_id, trim(unnest(k), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS id, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS k FROM documents)) WHERE id <> '' GROUP BY ALL)""")
def _(spark, d):
    return S.id_lists(T.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", F.md5("id").alias("id"))
