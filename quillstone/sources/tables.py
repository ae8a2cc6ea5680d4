"""The library's tables as views over the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.versions import Files

#: Rows of a document are numbered from doc_id * SEQ on; a text of 2 GB has fewer paragraphs.
SEQ = 1_000_000_000
#: Tables whose rows are texts: work on them is worth spreading.
TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, d: str, name: str, spread: bool = False) -> DataFrame:
    """A stored table. Texts, and with ``spread`` any rows, in fewer splits than half the cores, such as one small file, are dealt out to all cores."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name not in TEXTS and not spread:
        return df
    cores, files = spark.sparkContext.defaultParallelism, Files(spark).stamp(f"{d}/{name}.parquet")
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if 2 * max(1, sum(size for _, size, _ in files) // split) <= cores and len(files) < cores else df


def paras(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents: doc_id, lang, source, pos (from 0, blank ones not counted), text."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(kept).alias("pos", "text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows without claims: id, doc_key, pmid, type, text, section, page, tags, seq."""
    key = F.col("doc_id").cast("string")
    first = F.col("pos") == 0
    return paras(spark, d).select(
        F.when(first, F.concat(key, F.lit("::abstract::0"))).otherwise(F.concat(key, F.lit("::text::"), (F.col("pos") - 1).cast("string"))).alias("id"),
        key.alias("doc_key"), key.alias("pmid"), F.when(first, "abstract").otherwise("text").alias("type"), "text",
        F.col("lang").alias("section"), F.col("pos").cast("long").alias("page"), F.col("source").alias("tags"),
        (F.col("doc_id") * SEQ + F.col("pos")).alias("seq"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims: the first sentence of each document of quality 1, citing its abstract and, if doc_id is even, its first text row."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    p = paras(spark, d).where("pos < 2").groupBy("doc_id", "lang", "source").agg(
        F.max(F.when(F.col("pos") == 0, F.col("text"))).alias("abstract"), F.max(F.when(F.col("pos") == 1, F.col("text"))).alias("second"))
    key = F.col("doc_id").cast("string")
    span = F.when(F.instr("abstract", ".") > 0, F.substring("abstract", F.lit(1), F.instr("abstract", "."))).otherwise(F.col("abstract"))
    ids = F.array(F.concat(key, F.lit("::abstract::0")))
    both = F.array(F.concat(key, F.lit("::abstract::0")), F.concat(key, F.lit("::text::0")))
    return p.join(good, "doc_id").select(
        F.concat(key, F.lit("::claim::0")).alias("id"), key.alias("doc_key"), key.alias("pmid"), F.lit("claim").alias("type"), span.alias("text"), span.alias("evidence_span"),
        F.col("lang").alias("section"), F.lit(0).cast("long").alias("page"), F.col("source").alias("tags"), (F.col("doc_id") * SEQ + (SEQ - 1)).alias("seq"),
        F.when((F.col("doc_id") % 2 == 0) & F.col("second").isNotNull(), both).otherwise(ids).alias("source_chunk_ids"), "abstract", "second",
    )


COLUMNS = ["id", "doc_key", "pmid", "type", "text", "section", "page", "tags", "seq"]


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store: chunks and claims."""
    return chunks(spark, d).select(*COLUMNS).unionByName(claims(spark, d).select(*COLUMNS))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Bibliographic records from orders and their lines."""
    lines = (
        table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", F.col("s_name").alias("family"), F.col("n_name").alias("given"), "p_name", "p_type"))).alias("x"))
    )
    authors = F.transform("x", lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given")))
    none = F.array().cast("array<struct<family:string,given:string>>")
    return (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("doc_key"), F.col("o_orderkey").alias("n"), F.coalesce(authors, none).alias("authors"), F.col("c_mktsegment").alias("journal"),
            F.year("o_orderdate").cast("string").alias("year"), F.coalesce(F.array_sort(F.array_distinct(F.transform("x", lambda a: a["p_type"]))), F.array().cast("array<string>")).alias("keywords"),
            F.array("o_orderpriority").alias("pub_types"), F.get("x", F.lit(0))["p_name"].alias("title"), F.col("o_orderstatus").alias("volume"),
        )
    )


def triage(spark: SparkSession, d: str) -> DataFrame:
    inc = (F.col("quality") == 1) & (F.col("toxic") == 0)
    reason = F.when(~inc, F.when(F.col("toxic") == 1, "toxic").otherwise("low quality"))
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("pmid"), inc.alias("included"), reason.alias("reason"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Project members: labelled documents by language, and one id past the last in each (for pruning)."""
    docs = table(spark, d, "documents")
    m = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select(F.col("lang").alias("project"), F.col("doc_id").cast("string").alias("doc_key"))
    gone = docs.groupBy(F.col("lang").alias("project")).agg((F.max("doc_id") + 1000000).cast("string").alias("doc_key"))
    return m.unionByName(gone)


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row of each key: the first by position."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_n = 1").drop("_n")


#: The same views for DuckDB.
VIEWS = {
    "paras": "SELECT doc_id, lang, source, CAST(generate_subscripts(k, 1) - 1 AS BIGINT) AS pos, unnest(k) AS text FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS k FROM documents)",
    "chunks": "SELECT CASE WHEN pos = 0 THEN doc_id || '::abstract::0' ELSE doc_id || '::text::' || (pos - 1) END AS id, CAST(doc_id AS VARCHAR) AS doc_key, CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN pos = 0 THEN 'abstract' ELSE 'text' END AS type, text, lang AS section, pos AS page, source AS tags, doc_id * 1000000000 + pos AS seq FROM paras",
    "two": "SELECT doc_id, lang, source, max(CASE WHEN pos = 0 THEN text END) AS abstract, max(CASE WHEN pos = 1 THEN text END) AS second FROM paras WHERE pos < 2 GROUP BY ALL",
    "claims": "SELECT doc_id || '::claim::0' AS id, CAST(doc_id AS VARCHAR) AS doc_key, CAST(doc_id AS VARCHAR) AS pmid, 'claim' AS type, CASE WHEN instr(abstract, '.') > 0 THEN substr(abstract, 1, instr(abstract, '.')) ELSE abstract END AS text, lang AS section, CAST(0 AS BIGINT) AS page, source AS tags, doc_id * 1000000000 + 999999999 AS seq, CASE WHEN doc_id % 2 = 0 AND second IS NOT NULL THEN [doc_id || '::abstract::0', doc_id || '::text::0'] ELSE [doc_id || '::abstract::0'] END AS source_chunk_ids, abstract, second FROM two JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)",
    "rows_v": "SELECT id, doc_key, pmid, type, text, section, page, tags, seq FROM chunks UNION ALL SELECT id, doc_key, pmid, type, text, section, page, tags, seq FROM claims",
    "lines": "SELECT l_orderkey, list({'family': s_name, 'given': n_name} ORDER BY l_linenumber, l_suppkey, l_partkey) AS authors, list_sort(list_distinct(list(p_type))) AS keywords, first(p_name ORDER BY l_linenumber, l_suppkey, l_partkey) AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "papers": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_key, o_orderkey AS n, coalesce(authors, []) AS authors, c_mktsegment AS journal, CAST(year(o_orderdate) AS VARCHAR) AS year, coalesce(keywords, []) AS keywords, [o_orderpriority] AS pub_types, title, o_orderstatus AS volume FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON o_orderkey = l_orderkey",
    "triage": "SELECT CAST(doc_id AS VARCHAR) AS pmid, quality = 1 AND toxic = 0 AS included, CASE WHEN quality = 1 AND toxic = 0 THEN NULL WHEN toxic = 1 THEN 'toxic' ELSE 'low quality' END AS reason FROM labels",
    "members": "SELECT lang AS project, CAST(doc_id AS VARCHAR) AS doc_key FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) UNION ALL SELECT lang, CAST(max(doc_id) + 1000000 AS VARCHAR) FROM documents GROUP BY 1",
}
NEEDS = {"chunks": ["paras"], "two": ["paras"], "claims": ["two"], "rows_v": ["chunks", "claims"], "papers": ["lines"]}


def with_views(body: str, *views: str) -> str:
    """SQL of a query: the views it needs as common tables, then its body."""
    order: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not head:
        return f"WITH {body[1:].strip()}" if body.startswith(",") else body
    return f"WITH {head}{'' if body.startswith(',') else ' '}{body}"
