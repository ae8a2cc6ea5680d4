"""Queries of the ranking operators: BM25, dense, fusion, strategies, evaluation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from quillstone.functions.text import squash, tokenize
from quillstone.operators import retrieval as R
from quillstone.operators.passages import holding
from quillstone.operators.vectors import VectorIndex
from quillstone.operators.where import build, compile_where
from quillstone.plans.indexes import index_of
from quillstone.plans.registry import query
from quillstone.sources import tables as T
from quillstone.sources.versions import Files, stored, workspace

ASKED = ["the", "ouwhea", "rend", "threlyes", "rend"]
QUERY_VEC = 7

#: Statistics of BM25 over ``c`` (id, text) for DuckDB, and the scores of all rows for the terms asked as ``sc``.
STATS = """, tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT c.id, count(term) AS dl FROM c LEFT JOIN tok USING (id) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term, n),
ts AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)
"""
BM25 = STATS + """, q AS (SELECT unnest(['the', 'ouwhea', 'rend', 'threlyes', 'rend']) AS term),
hit AS (SELECT post.id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (id), st GROUP BY 1),
sc AS (SELECT c.*, round(coalesce(s, 0), 9) AS score FROM c LEFT JOIN hit USING (id))
"""
DOCS = ", c AS (SELECT doc_id AS id, doc_id AS seq, text, lang FROM documents)" + BM25
ROWS = ", c AS (SELECT * FROM rows_v)" + BM25
DENSE = """, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), qv AS (SELECT v AS q FROM v WHERE id = 7),
dist AS (SELECT id, label, round(1 - list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 9) AS dist FROM v, qv)
"""


def docs(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def vecs(spark, d):
    return T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked_vec(spark, d):
    return vecs(spark, d).where(F.col("id") == QUERY_VEC).select(F.col("v").alias("q"))


@query("tokenize", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS digest FROM documents")
def _(spark, d):
    t = tokenize(F.col("text"))
    return T.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("normalize_text", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents")
def _(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.md5(squash(F.col("text"))).alias("digest"))


@query("bm25_postings", DOCS + "SELECT id, term, tf, dl FROM post JOIN dl USING (id)")
def _(spark, d):
    return R.postings(docs(spark, d))


@query("bm25_term_stats", DOCS + "SELECT term, df, round(idf, 6) AS idf FROM ts")
def _(spark, d):
    x = docs(spark, d)
    return R.term_stats(R.postings(x), R.corpus_stats(x)).withColumn("idf", F.round("idf", 6))


@query("bm25_corpus_stats", DOCS + "SELECT n, round(avgdl, 6) AS avgdl FROM st")
def _(spark, d):
    return R.corpus_stats(docs(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_build", DOCS + "SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT id) AS n_docs FROM post")
def _(spark, d):
    return R.postings(docs(spark, d)).agg(F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.count_distinct("id").alias("n_docs"))


@query("bm25_scores", DOCS + "SELECT id, round(s, 6) AS score FROM hit")
def _(spark, d):
    return index_of(spark, d, "documents").scores(ASKED).withColumn("score", F.round("score", 6))


@query("bm25_topk", DOCS + "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS lex_rank FROM sc ORDER BY score DESC, id LIMIT 20")
def _(spark, d):
    return index_of(spark, d, "documents").top(ASKED, 20).select("id", F.round("score", 6).alias("score"), "lex_rank")


@query("bm25_topk_filtered", DOCS + "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS lex_rank FROM sc WHERE lang = 'fr' ORDER BY score DESC, id LIMIT 20")
def _(spark, d):
    return index_of(spark, d, "documents").top(ASKED, 20, compile_where({"lang": "fr"}, ["lang"])).select("id", F.round("score", 6).alias("score"), "lex_rank")


@query("lexical_only", DOCS + "SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lex_rank, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)), 6) AS score FROM sc ORDER BY lex_rank LIMIT 5")
def _(spark, d):
    return index_of(spark, d, "documents").top(ASKED, 20).select("id", "lex_rank", F.round(F.lit(1.0) / (R.RRF_K + F.col("lex_rank")), 6).alias("score")).orderBy("lex_rank").limit(5)


@query("dense_topk", DENSE + "SELECT id, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, id) AS dense_rank FROM dist ORDER BY dist, id LIMIT 20")
def _(spark, d):
    return R.dense(vecs(spark, d), asked_vec(spark, d), 20).withColumn("dist", F.round("dist", 6))


@query("dense_topk_filtered", DENSE + "SELECT id, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, id) AS dense_rank FROM dist WHERE label IN (1, 3) ORDER BY dist, id LIMIT 20")
def _(spark, d):
    return R.dense(vecs(spark, d), asked_vec(spark, d), 20, compile_where({"label": {"$in": [1, 3]}}, ["label"])).withColumn("dist", F.round("dist", 6))


@query("dense_only", DENSE + "SELECT id, row_number() OVER (ORDER BY dist, id) AS dense_rank, round(1.0 / (60 + row_number() OVER (ORDER BY dist, id)), 6) AS score FROM dist ORDER BY dense_rank LIMIT 5")
def _(spark, d):
    return R.dense(vecs(spark, d), asked_vec(spark, d), 20).select("id", "dense_rank", F.round(F.lit(1.0) / (R.RRF_K + F.col("dense_rank")), 6).alias("score")).orderBy("dense_rank").limit(5)


_LEGS = """, dn AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS dense_rank FROM dist ORDER BY 2 LIMIT {pool}),
lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lex_rank FROM sc ORDER BY 2 LIMIT {pool}),
fu AS (SELECT coalesce(dn.id, lx.id) AS id, dense_rank, lex_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 9) AS score FROM dn FULL JOIN lx ON dn.id = lx.id)
"""
FUSED = DOCS + DENSE + _LEGS


def fused(spark, d, k, pool):
    return R.fuse(R.dense(vecs(spark, d), asked_vec(spark, d), pool), index_of(spark, d, "documents").top(ASKED, pool), k)


@query("rrf_fusion", FUSED.format(pool=20) + "SELECT id, dense_rank, lex_rank, round(score, 6) AS score FROM fu ORDER BY fu.score DESC, id LIMIT 40")
def _(spark, d):
    return fused(spark, d, 40, 20).withColumn("score", F.round("score", 6))


@query("hybrid_topk", FUSED.format(pool=40) + ", top AS (SELECT * FROM fu ORDER BY score DESC, id LIMIT 10) SELECT top.id, dense_rank, lex_rank, round(score, 6) AS score, lang, source, n_chars FROM top LEFT JOIN documents ON doc_id = id")
def _(spark, d):
    top = fused(spark, d, 10, 10 * R.POOL).withColumn("score", F.round("score", 6))
    meta = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return meta.join(F.broadcast(top), "id", "right").select("id", "dense_rank", "lex_rank", "score", "lang", "source", "n_chars")  # ten rows


def row_hits(spark, d, k, where):
    index = index_of(spark, d, "rows")
    return index.top(ASKED, k, compile_where(where, index.rows.columns))


for _name, _where, _cond in (("strategy_chunks", {"type": {"$ne": "claim"}}, "type <> 'claim'"), ("strategy_claims", {"type": "claim"}, "type = 'claim'"), ("mixed_strategy", None, "true"), ("type_shorthand", build("abstract"), "type = 'abstract'")):
    query(_name, ROWS + f"SELECT id, type, doc_key, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, seq) AS lex_rank FROM sc WHERE {_cond} ORDER BY score DESC, seq LIMIT 12", "rows_v")(
        lambda spark, d, w=_where: row_hits(spark, d, 12, w).select("id", "type", "doc_key", F.round("score", 6).alias("score"), "lex_rank"))


@query("expand_claims", "SELECT c.id, s.source_id, s.pos, md5(chunks.text) AS digest FROM claims c, (SELECT id, unnest(source_chunk_ids) AS source_id, CAST(generate_subscripts(source_chunk_ids, 1) - 1 AS BIGINT) AS pos FROM claims) s JOIN chunks ON chunks.id = s.source_id WHERE s.id = c.id", "claims", "chunks")
def _(spark, d):
    return R.expand(T.claims(spark, d), T.chunks(spark, d)).withColumn("digest", F.md5("text")).drop("text")


@query("merged_strategy", ROWS + """, cl AS (SELECT id, score FROM sc WHERE type = 'claim' ORDER BY score DESC, seq LIMIT 8),
ch AS (SELECT id, score FROM sc WHERE type <> 'claim' ORDER BY score DESC, seq LIMIT 30)
SELECT id, round(score, 6) AS score, CAST(0 AS BIGINT) AS section FROM cl UNION ALL
SELECT id, round(score, 6), 1 FROM ch WHERE id NOT IN (SELECT unnest(source_chunk_ids) FROM claims WHERE id IN (SELECT id FROM cl))""", "rows_v")
def _(spark, d):
    index, claim = index_of(spark, d, "rows"), F.col("type") == "claim"
    cl, ch = index.top(ASKED, 8, claim), index.top(ASKED, 30, ~claim)
    part = lambda df: df.select("id", F.round("score", 6).alias("score"))
    return R.merge(part(cl), part(ch), cl.select("id", "source_chunk_ids"))


#: For evaluation: the first sentences of items found in documents are questions, the papers that hold the item are relevant.
EVAL = ROWS.replace(BM25, STATS) + r""", rel AS (SELECT item_id AS qid, CAST(doc_id AS VARCHAR) AS pmid FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(regexp_extract(text, '^[^.]*[.]?')), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id IN (SELECT qid FROM rel)) GROUP BY ALL),
hit AS (SELECT qid, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (id), st GROUP BY 1, 2),
pl AS (SELECT s, qid, id, pmid, row_number() OVER (PARTITION BY s, qid ORDER BY score DESC, seq) AS place FROM hit JOIN rows_v USING (id), (VALUES ('claims'), ('chunks'), ('mixed')) t(s) WHERE s = 'mixed' OR (s = 'claims') = (type = 'claim')),
cited AS (SELECT qid, unnest(source_chunk_ids) AS id FROM pl JOIN claims USING (id) WHERE s = 'claims' AND place <= 3),
mg AS (SELECT qid, pmid, 0 AS part, place FROM pl WHERE s = 'claims' AND place <= 3 UNION ALL SELECT qid, pmid, 1, place FROM pl ANTI JOIN cited USING (qid, id) WHERE s = 'chunks' AND place <= 5),
rk AS (SELECT s AS strategy, qid, pmid, place AS rank FROM pl WHERE place <= 5 UNION ALL SELECT 'merged', qid, pmid, row_number() OVER (PARTITION BY qid ORDER BY part, place) FROM mg),
fs AS (SELECT strategy, qid, pmid, row_number() OVER (PARTITION BY strategy, qid ORDER BY min(rank)) AS place FROM rk GROUP BY strategy, qid, pmid),
per AS (SELECT strategy, qid, sum(CASE WHEN rel.pmid IS NOT NULL THEN 1 ELSE 0 END) AS got, min(CASE WHEN rel.pmid IS NOT NULL THEN place END) AS best FROM fs LEFT JOIN rel USING (qid, pmid) GROUP BY ALL),
ev AS (SELECT strategy, qid, CAST(coalesce(got, 0) > 0 AS BIGINT) AS hit, round(coalesce(got, 0) / n, 6) AS recall, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr
  FROM (SELECT qid, count(*) AS n FROM rel GROUP BY 1) CROSS JOIN (SELECT DISTINCT strategy FROM rk) LEFT JOIN per USING (strategy, qid))
"""


def evaluated(spark, d):
    items = T.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("asked"))
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    rel = stored(holding(docs, items).select("qid", F.col("doc_id").cast("string").alias("pmid")), "relevant")  # read three times
    questions = items.join(rel.select("qid").distinct(), "qid", "left_semi").select("qid", F.regexp_extract("asked", r"^[^.]*[.]?", 0).alias("text"))
    return R.scores_of(R.evaluate(index_of(spark, d, "rows"), questions, 5, 3), rel)


@query("eval_metrics", EVAL + "SELECT * FROM ev", "rows_v")
def _(spark, d):
    return evaluated(spark, d)


@query("eval_summary", EVAL + "SELECT strategy, count(*) AS n, round(avg(hit), 3) AS hit, round(avg(recall), 3) AS recall, round(avg(mrr), 3) AS mrr FROM ev GROUP BY 1", "rows_v")
def _(spark, d):
    return evaluated(spark, d).groupBy("strategy").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("hit", "recall", "mrr")])


for _i, (_tree, _cond) in enumerate([
    ({"type": {"$eq": "claim"}}, "type = 'claim'"), ({"section": {"$ne": "en"}}, "section <> 'en'"), ({"section": {"$in": ["de", "fr"]}}, "section IN ('de', 'fr')"),
    ({"tags": {"$nin": ["src0", "src1"]}}, "tags NOT IN ('src0', 'src1')"), ({"page": 1}, "page = 1"), ({"missing": {"$ne": "x"}}, "true"), ({"missing": {"$in": ["x", None]}}, "true"),
    ({"missing": {"$nin": ["x"]}, "type": "text"}, "type = 'text'"), ({"$and": [{"type": "text"}, {"$or": [{"section": "es"}, {"page": {"$eq": 2}}]}], "type": "claim"}, "type = 'text' AND (section = 'es' OR page = 2)"),
    ({"missing": "None", "section": {"$ne": "en", "$in": ["en", "es"]}}, "section = 'es'"),
]):
    query(f"where_filter_{_i}", f"SELECT id, type, section FROM rows_v WHERE {_cond}", "rows_v")(lambda spark, d, t=_tree: (r := T.rows(spark, d)).where(compile_where(t, r.columns)).select("id", "type", "section"))
query("where_builder", "SELECT id FROM rows_v WHERE type = 'text' AND pmid = '5'", "rows_v")(lambda spark, d: (r := T.rows(spark, d)).where(compile_where(build("text", "5"), r.columns)).select("id"))


def vector_index(spark, d):
    """The index of the stored vectors as they are; other files at the path make another."""
    files = Files(spark)
    path = f"{workspace(spark)}/vectors-{hashlib.md5(json.dumps([d, files.stamp(f'{d}/embeddings.parquet')]).encode()).hexdigest()}"
    return VectorIndex.read(spark, path) if files.exists(f"{path}/codes") else VectorIndex.build(vecs(spark, d), path)


@query("dense_index_exact", DENSE + "SELECT id, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, id) AS dense_rank FROM dist WHERE label IN (1, 3) ORDER BY dist, id LIMIT 20")
def _(spark, d):
    q = asked_vec(spark, d).first()["q"]
    return vector_index(spark, d).search(q, 20, None, compile_where({"label": {"$in": [1, 3]}}, ["label"])).withColumn("dist", F.round("dist", 6))


@query("dense_index_topk")
def _(spark, d):
    """Approximate, so no SQL gives its rows; tests measure recall against the exact answer."""
    return vector_index(spark, d).search(asked_vec(spark, d).first()["q"], 20).withColumn("dist", F.round("dist", 6))
