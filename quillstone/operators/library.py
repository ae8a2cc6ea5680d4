"""The row store's mutations, roll-ups and projects, as relational steps over immutable tables.

A mutation returns the table as it is to be; writers put it at a new path and switch to that, since a path being read
can't be overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import human_mb  # noqa: F401  part of this module's functions
from quillstone.operators.biblio import authors_summary, last_author


def lookup(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the ids asked for; the list comes with the call and is as small as that."""
    return rows.where(F.col("id").isin(ids))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones whose key isn't among them."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, key, "left_anti")


def replace(rows: DataFrame, new: DataFrame, key: str, of: Column | None = None) -> DataFrame:
    """All rows (meeting ``of``) of the new rows' keys go, and the new ones come: no stale ids are left."""
    gone = new.select(F.col(key).alias("_gone")).distinct()
    hit = F.col(key) == F.col("_gone")
    return rows.join(gone, hit if of is None else hit & of, "left_anti").unionByName(new)


def patch(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """The column set to ``value`` in rows of the keys, which are distinct."""
    marked = keys.withColumn("_hit", F.lit(True))
    return rows.join(marked, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def tag_set(new: Column) -> Column:
    return new


def tag_add(tags: Column, new: Column) -> Column:
    """Tags, then the new ones not among them; repeats inside the new ones stay."""
    return F.concat(tags, F.filter(new, lambda x: ~F.array_contains(tags, x)))


def tag_remove(tags: Column, gone: Column) -> Column:
    return F.filter(tags, lambda x: ~F.array_contains(gone, x))


def tag_parse(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def embedded_counts(rows: DataFrame) -> DataFrame:
    claim = F.equal_null("type", F.lit("claim"))
    return rows.where("doc_key IS NOT NULL AND doc_key <> ''").groupBy("doc_key").agg(F.count_if(~claim).alias("n_chunks"), F.count_if(claim).alias("n_claims"))


def claims_status(rows: DataFrame, missing: bool = False) -> DataFrame:
    out = rows.groupBy("doc_key").agg(F.count_if(F.col("type") == "claim").alias("n_claims"), F.count_if(F.col("type").isin("text", "abstract")).alias("n_source_chunks"), F.min_by("pmid", "seq").alias("pmid")).where("n_source_chunks > 0")
    return out.where("n_claims = 0") if missing else out


def claims_by_doc(claims: DataFrame) -> DataFrame:
    """Claims of each document in order of the number at the id's end."""
    n = F.try_to_number(F.substring_index("id", "::", -1), F.lit("999999999")).cast("int")
    lists = claims.groupBy("doc_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(n.alias("n"), "id"))).alias("x"))
    return lists.select("doc_key", "n", F.array_join(F.transform("x", lambda r: r["id"]), " ").alias("ids"))


def source_level(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    kinds = claims.select("id", F.explode("source_chunk_ids").alias("sid")).join(chunks.select(F.col("id").alias("sid"), "type"), "sid").groupBy("id").agg(F.collect_set("type").alias("k"))
    return kinds.select("id", F.when(F.size("k") > 1, "mixed").when(F.array_contains("k", "abstract"), "abstract").otherwise("fulltext").alias("level"))


def unknown_sources(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    return claims.select("id", F.explode("source_chunk_ids").alias("sid")).join(chunks.select(F.col("id").alias("sid")), "sid", "left_anti").select("id", "sid")


def storage(docs: DataFrame, budget: int) -> DataFrame:
    """Bytes by language, and per cent of the budget between 2 and 100."""
    return docs.groupBy("lang").agg(F.sum("n_chars").alias("bytes")).withColumn("fill", F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.bround(100.0 * F.col("bytes") / budget, 0))).cast("long"))


def dashboard(papers: DataFrame, counts: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return papers.join(counts, "doc_key", "left").select("doc_key", "title", "journal", "year", zero("n_chunks").alias("n_chunks"), zero("n_claims").alias("n_claims"), (zero("n_chunks") > 0).alias("has_embedding"))


PAGED = "source.pdf", "source.xml", "source.html"


def paper_rows(papers: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """A dashboard's row of each paper: its record, what lies in its folder (doc_key, name, length), its figures and claims.

    Figures and claims are lists in order of the number at the id's end; a claim has the page of its first source. The
    pages of a PDF aren't counted, and columns that papers or rows don't have count as null.
    """
    def of(df, name, kind="string"):
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    number = F.try_to_number(F.substring_index("id", "::", -1), F.lit("999999999")).cast("int").alias("n")
    pdf, xml, html = (F.col("name") == n for n in PAGED)
    held = files.groupBy("doc_key").agg(F.max(F.when(pdf, F.col("length"))).alias("_pdf"), F.max(xml).alias("_xml"), F.max(html).alias("_html"))
    figures = rows.where("type = 'figure'").groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(number, "text"))).alias("_figures"))
    source = rows.select(F.col("id").alias("_source"), F.col("page").alias("_page"))
    claim = rows.where("type = 'claim'").withColumn("_first", F.get(of(rows, "source_chunk_ids", "array<string>"), F.lit(0))).join(source, F.col("_first") == F.col("_source"), "left")
    fields = [number, F.col("id"), F.col("text"), F.col("_page").alias("page"), *[of(rows, c).alias(c) for c in ("section", "direction", "evidence_span", "source_level")]]
    claims = claim.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_claims"))
    all_ = papers.join(embedded_counts(rows), "doc_key", "left").join(held, "doc_key", "left").join(figures, "doc_key", "left").join(claims, "doc_key", "left")
    zero, flag = lambda c: F.coalesce(c, F.lit(0)), lambda c: F.coalesce(c, F.lit(False))
    n = F.coalesce(F.size("_figures"), F.lit(0))
    some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    authors = F.coalesce(of(papers, "authors", "array<struct<family:string,given:string>>"), F.array().cast("array<struct<family:string,given:string>>"))
    listed = lambda c: F.coalesce(of(papers, c, "array<string>"), F.array().cast("array<string>")).alias(c)
    return all_.select(
        "doc_key", *[of(papers, c).alias(c) for c in ("pmid", "pmcid", "title")], authors_summary(authors).alias("authors"), authors.alias("authors_full"), last_author(authors).alias("last_author"),
        *[of(papers, c).alias(c) for c in ("journal", "year", "volume", "issue", "pages", "doi", "abstract")], listed("keywords"), listed("pub_types"), flag(of(papers, "has_fulltext", "boolean")).alias("has_fulltext"),
        F.col("_pdf").isNotNull().alias("has_pdf"), F.when(F.col("_pdf").isNotNull(), human_mb(F.col("_pdf"))).alias("pdf_size"), F.lit(None).cast("long").alias("pdf_pages"), flag(F.col("_xml")).alias("has_xml"), flag(F.col("_html")).alias("has_html"),
        n.cast("long").alias("n_figures"), F.when(n > 0, F.concat(F.lit("figs/"), "doc_key", F.lit(".png"))).alias("cover"),
        F.transform(some, lambda i: F.concat(F.lit("figs/"), F.col("doc_key"), F.lit("_"), i.cast("string"), F.lit(".png"))).alias("figures"), F.transform(F.coalesce("_figures", F.array().cast("array<struct<n:int,text:string>>")), lambda f: f["text"]).alias("figure_captions"),
        zero(F.col("n_chunks")).alias("n_chunks"), (zero(F.col("n_chunks")) > 0).alias("has_embedding"), zero(F.col("n_claims")).alias("n_claims"),
        F.coalesce(F.transform("_claims", lambda c: c.dropFields("n")), F.array()).alias("claims"),
    )


def project_list(members: DataFrame, searches: DataFrame) -> DataFrame:
    n = members.groupBy("project").agg(F.count("*").alias("n_members"))
    return n.join(searches.groupBy("project").agg(F.count("*").alias("n")), "project", "left").select("project", "n_members", F.coalesce("n", F.lit(0)).alias("n_searches"))


def pruned(members: DataFrame, present: DataFrame) -> DataFrame:
    return members.join(present, "doc_key", "left_anti").select("project", "doc_key")


def link_plan(members: DataFrame, linked: DataFrame) -> DataFrame:
    m, x = members.withColumn("_m", F.lit(1)), linked.withColumn("_x", F.lit(1))
    action = F.when(F.col("_x").isNull(), "link").when(F.col("_m").isNull(), "unlink").otherwise("keep")
    return m.join(x, "doc_key", "full_outer").select("doc_key", action.alias("action"))


def add_members(members: DataFrame, new: DataFrame, via: str) -> DataFrame:
    """Members after the new ones came by ``via``, which a member gets once."""
    both = members.join(new.withColumn("_new", F.lit(True)), "doc_key", "full_outer")
    had = F.coalesce("via", F.array().cast("array<string>"))
    return both.select("doc_key", F.col("via").isNull().alias("is_new"), F.when(F.col("_new"), tag_add(had, F.array(F.lit(via)))).otherwise(had).alias("via"))


def membership(refs: DataFrame, members: DataFrame) -> DataFrame:
    return refs.join(members.distinct(), F.col("ref") == F.col("doc_key"), "left").select("ref", F.col("doc_key").isNotNull().alias("was_member"))


def resolve(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """A reference is a doc_key, else a pmid, else unresolved (null)."""
    direct, by_pmid = papers.select(F.col("doc_key").alias("_d")), papers.select("pmid", F.col("doc_key").alias("_p"))
    return refs.join(direct, F.col("ref") == F.col("_d"), "left").join(by_pmid, F.col("ref") == F.col("pmid"), "left").select("ref", F.coalesce("_d", "_p").alias("doc_key"))
