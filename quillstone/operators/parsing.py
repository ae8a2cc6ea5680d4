"""Parsing of articles, records and descriptor files, chunking and captions, as expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X

#: Tokens that an embedding model takes (fixed values); others take DEFAULT_TOKENS.
MODEL_TOKENS = {
    "BAAI/bge-small-en-v1.5": 512,
    "BAAI/bge-base-en-v1.5": 512,
    "BAAI/bge-large-en-v1.5": 512,
    "BAAI/bge-m3": 8192,
    "jinaai/jina-embeddings-v2-base-en": 8192,
}
DEFAULT_TOKENS = 512
IMAGES = ["jpg", "jpeg", "png", "gif", "tif", "tiff"]


def without_doctype(xml: Column) -> Column:
    """XPath would try to open the external DTD."""
    return F.regexp_replace(xml, r"(?s)<!DOCTYPE[^>]*>", "")


def unwrap_article(xml: Column) -> Column:
    """The article element inside a set of articles, without processing notes."""
    return X.nullif_empty(F.regexp_replace(F.regexp_extract(xml, r"(?s)(<article[ >].*</article>)", 1), r"(?s)<processing-meta.*?</processing-meta>|<processing-meta[^>]*/>", ""))


def _at(xml: Column, path: str) -> Column:
    return X.nullif_empty(F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(path)), r"(?U)\s+", " ")))


def jats_front(docs: DataFrame) -> DataFrame:
    """Citation fields of JATS articles (column xml); an element's whole text counts, and missing ones are null."""
    d = docs.withColumn("xml", without_doctype(F.col("xml")))
    meta = "/article/front/article-meta"
    people = f"{meta}/contrib-group/contrib[@contrib-type='author']/name"
    x = F.col("xml")
    first, last = _at(x, f"{meta}/fpage"), _at(x, f"{meta}/lpage")
    return d.select(
        *[c for c in docs.columns if c != "xml"],
        _at(x, f"{meta}/article-id[@pub-id-type='pmid']").alias("pmid"), _at(x, f"{meta}/article-id[@pub-id-type='doi']").alias("doi"),
        _at(x, f"{meta}/title-group/article-title").alias("title"), _at(x, "/article/front/journal-meta//journal-title").alias("journal"),
        X.year_of(_at(x, f"{meta}/pub-date/year")).alias("year"), _at(x, f"{meta}/volume").alias("volume"), _at(x, f"{meta}/issue").alias("issue"),
        F.when(first.isNotNull(), F.concat_ws("-", first, last)).alias("pages"), _at(x, f"{meta}/abstract").alias("abstract"),
        F.arrays_zip(F.xpath(x, F.lit(f"{people}/surname/text()")).alias("family"), F.xpath(x, F.lit(f"{people}/given-names/text()")).alias("given")).alias("authors"),
        F.xpath(x, F.lit(f"{meta}/kwd-group/kwd/text()")).alias("keywords"),
    )


def pubmed_record(docs: DataFrame) -> DataFrame:
    """Citation fields of PubMed records (column xml, one article each)."""
    d = docs.withColumn("xml", without_doctype(F.col("xml")))
    x, a = F.col("xml"), "//MedlineCitation/Article"
    return d.select(
        *[c for c in docs.columns if c != "xml"],
        _at(x, "//MedlineCitation/PMID").alias("pmid"), _at(x, f"{a}/ArticleTitle").alias("title"), _at(x, f"{a}/Journal/Title").alias("journal"),
        F.coalesce(X.year_of(_at(x, f"{a}/Journal/JournalIssue/PubDate/Year")), X.year_of(_at(x, f"{a}/Journal/JournalIssue/PubDate/MedlineDate"))).alias("year"),
        _at(x, f"{a}/Journal/JournalIssue/Volume").alias("volume"), _at(x, f"{a}/Pagination/MedlinePgn").alias("pages"),
        X.nullif_empty(F.array_join(F.xpath(x, F.lit(f"{a}/Abstract/AbstractText/text()")), " ")).alias("abstract"),
        _at(x, "//ArticleIdList/ArticleId[@IdType='doi']").alias("doi"),
        F.arrays_zip(F.xpath(x, F.lit(f"{a}/AuthorList/Author/LastName/text()")).alias("family"), F.xpath(x, F.lit(f"{a}/AuthorList/Author/ForeName/text()")).alias("given")).alias("authors"),
        F.xpath(x, F.lit(f"{a}/PublicationTypeList/PublicationType/text()")).alias("pub_types"),
    )


def mesh_terms(docs: DataFrame) -> DataFrame:
    """(record, ui, heading, term) of descriptor records (record, xml): the name and all terms."""
    x = without_doctype(F.col("xml"))
    terms = F.array_distinct(F.concat(F.array(F.xpath_string(x, F.lit("/DescriptorRecord/DescriptorName/String"))), F.xpath(x, F.lit("//TermList/Term/String/text()"))))
    return docs.select("record", F.xpath_string(x, F.lit("/DescriptorRecord/DescriptorUI")).alias("ui"), F.xpath_string(x, F.lit("/DescriptorRecord/DescriptorName/String")).alias("heading"), F.explode(terms).alias("term")).where("term <> ''")


def max_tokens(model: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in MODEL_TOKENS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, model), F.lit(DEFAULT_TOKENS)).cast("long")


def heading_path(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), " > ")


def chunk(paras: DataFrame, most_words: int) -> DataFrame:
    """(doc_id, chunk, text) of paragraphs (doc_id, pos, text): paragraphs in order, joined up to ``most_words`` words by running totals."""
    words = F.size(F.split(F.trim("text"), " +"))
    before = F.sum("w").over(Window.partitionBy("doc_id").orderBy("pos")) - F.col("w")
    at = paras.withColumn("w", words.cast("long")).withColumn("chunk", F.floor(before / most_words).cast("long"))
    lists = at.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return lists.select("doc_id", "chunk", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


def nearest_caption(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, figure, caption): the caption of the nearest page, the following page first, then the first in the list.

    Captions of a document go into one list, which its figures look through: no pair is made.
    """
    lists = captions.groupBy("doc").agg(F.collect_list(F.struct("page", "pos", "caption")).alias("x"))
    rank = lambda c: F.struct(F.abs(c["page"] - F.col("page")).alias("d"), F.when(c["page"] >= F.col("page"), 0).otherwise(1).alias("s"), c["pos"].alias("pos"), c["caption"].alias("caption"))
    return figures.join(lists, "doc", "left").select("doc", "figure", F.array_min(F.transform("x", rank))["caption"].alias("caption"))


#: What a caption starts with (fixed pattern), and the 500 characters from there on, seen without being consumed.
CAPTION = r"(?im)^(?=Fig(?:ure)?\.?\s*[0-9]+\s*[|:.])(?=((?s:.{1,500})))"


def caption_scan(text: Column) -> Column:
    """Captions of a page's text: from a figure label at the start of a line to a blank line, 500 characters at most."""
    windows = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1))
    return F.transform(windows, lambda c: F.trim(F.replace(F.get(F.split(c, r"\n\s*\n"), F.lit(0)), F.lit("\n"), F.lit(" "))))


def infer_filename(url: Column, content_type: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*/(?:.*/)?([^/]*)$", 1)
    stem = F.coalesce(X.nullif_empty(name), F.lit("download"))
    kind = F.when(F.contains(content_type, F.lit("pdf")), ".pdf").when(F.contains(content_type, F.lit("html")), ".html").when(F.contains(content_type, F.lit("xml")), ".xml").otherwise(".bin")
    return F.when(stem.rlike(r"\.[A-Za-z0-9]{1,5}$"), stem).otherwise(F.concat(stem, kind))


def latest_version(keys: DataFrame) -> DataFrame:
    """(article, prefix): of prefixes ``article.n`` that with the largest number."""
    number = F.element_at(F.split("prefix", r"\."), -1).cast("int")
    return keys.groupBy("article").agg(F.max_by("prefix", number).alias("prefix"))
