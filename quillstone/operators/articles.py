"""Articles in XML to the library: a record of each paper, and rows for its chunks, figures and abstract.

An article is a row (doc_key, xml, record, tags): its JATS text, the service's record of the paper and tags, all but the key null
where they are missing. XML that isn't well-formed counts as missing, so one broken article fails no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import parsing as P
from quillstone.operators.token_chunks import token_chunks

ARTICLE = "doc_key string, xml string, record string, tags array<string>"
BLOCKS = "doc_key string, pos int, kind string, heading string, text string"
NO_CAPTION = "(uncaptioned figure)"
#: Rows of a paper are numbered from a hash of its key times PAPER on: chunks, then figures and the abstract; claims come after 1_000_000.
PAPER, FIGURES, ABSTRACT = 4_000_000, 500_000, 900_000


def shaped(articles: DataFrame) -> DataFrame:
    """Articles with all columns of ARTICLE; those that aren't given are null."""
    return articles.select(*[(F.col(n) if n in articles.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ") for c in ARTICLE.split(", "))])


def parsed(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(xml) if xml else None
    except (ElementTree.ParseError, ValueError, RecursionError):
        return None


def sound(articles: DataFrame) -> DataFrame:
    """ARTICLE rows, the article taken out of a set of articles, and null for XML that isn't well-formed."""

    def rows(batches):
        for b in batches:
            for name in ("xml", "record"):
                i = b.schema.get_field_index(name)
                b = b.set_column(i, name, pa.array([t if parsed(t) is not None else None for t in b.column(i).to_pylist()], pa.string()))
            yield b

    own = shaped(articles).withColumns({"xml": P.unwrap_article(P.without_doctype(F.col("xml"))), "record": P.without_doctype(F.col("record"))})
    return own.mapInArrow(rows, ARTICLE)


def flat(node: ElementTree.Element | None, leave: frozenset[str] = frozenset()) -> str:
    """An element's whole text on one line, without that of elements to leave out."""

    def texts(n):
        yield n.text or ""
        for child in n:
            if child.tag not in leave:
                yield from texts(child)
            yield child.tail or ""

    return "" if node is None else " ".join("".join(texts(node)).split())


_FIGURES = frozenset({"fig", "fig-group"})


def figure(node: ElementTree.Element, heading: str) -> tuple[str, str, str]:
    return "figure", heading, " ".join(t for t in (flat(node.find("label")), flat(node.find("caption"))) if t)


def walk(node: ElementTree.Element, path: list[str]) -> Iterator[tuple[str, str, str]]:
    """(kind, heading, text) of the paragraphs and figures below a section in order; figures inside a paragraph come after it."""
    heading = " > ".join(path)
    for child in node:
        if child.tag == "sec":
            title = flat(child.find("title"))
            yield from walk(child, [*path, title] if title else path)
        elif child.tag in ("p", "list", "disp-quote"):
            if text := flat(child, _FIGURES):
                yield "text", heading, text
            yield from (figure(f, heading) for f in child.iter("fig"))
        elif child.tag == "fig":
            yield figure(child, heading)
        elif child.tag not in ("title", "label", "ref-list"):
            yield from walk(child, path)


def blocks(articles: DataFrame) -> DataFrame:
    """BLOCKS of sound articles: paragraphs and figures of the body with the path of headings above them.

    XPath gives lists of texts without their places in the tree; so a parser walks each article, a batch of them at a time.
    """

    def rows(batches):
        for b in batches:
            out = []
            for key, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root = parsed(xml)
                body = None if root is None else root.find("body")
                out += [(key, pos, *of) for pos, of in enumerate(walk(body, []) if body is not None else [])]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return articles.select("doc_key", "xml").mapInArrow(rows, BLOCKS)


def words_for(model: str) -> int:
    """Words that a chunk may have: three for every four tokens that the model takes."""
    return P.MODEL_TOKENS.get(model, P.DEFAULT_TOKENS) * 3 // 4


def section_chunks(blocks: DataFrame, most: int) -> DataFrame:
    """(doc_key, chunk, heading, text): neighbouring paragraphs under one heading, joined up to ``most`` words, the headings in front.

    Reference lists and abstracts are left out. Paragraphs are cut to half of ``most`` and joined by running totals over that
    half, so no chunk has more than ``most`` words of its own.
    """
    half = max(1, most // 2)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    kept = blocks.where((F.col("kind") == "text") & ~X.skipped_section(F.col("heading"))).withColumn("w", words).where(F.size("w") > 0)
    cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / half).cast("int") - 1), lambda i: F.slice("w", i * half + 1, F.lit(half)))
    pieces = kept.select("doc_key", "pos", "heading", F.posexplode(cuts).alias("k", "w")).withColumn("n", F.size("w"))
    each = Window.partitionBy("doc_key").orderBy("pos", "k")
    other = ~F.col("heading").eqNullSafe(F.lag("heading").over(each))
    runs = pieces.withColumn("other", other.cast("int")).withColumn("run", F.sum("other").over(each))
    before = F.sum("n").over(Window.partitionBy("doc_key", "run").orderBy("pos", "k")) - F.col("n")
    parts = runs.withColumn("part", F.floor(before / half)).groupBy("doc_key", "run", "part", "heading").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "w"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda r: F.concat(F.when(r["k"] > 0, " ").otherwise("\n"), F.array_join(r["w"], " "))), "")
    text = F.ltrim(joined, F.lit(" \n"))
    head = F.when(F.coalesce(F.col("heading") != "", F.lit(False)), F.concat(F.replace("heading", F.lit(" > "), F.lit("\n")), F.lit("\n"))).otherwise("")
    number = F.row_number().over(Window.partitionBy("doc_key").orderBy("run", "part")) - 1
    return parts.select("doc_key", number.cast("long").alias("chunk"), "heading", F.concat(head, text).alias("text"))


def records(articles: DataFrame) -> DataFrame:
    """The paper of each sound article: fields of the service's record, and of the article's front where that has none."""
    front = P.jats_front(articles.select("doc_key", "xml", "record", "tags"))
    both = P.pubmed_record(articles.select("doc_key", F.col("record").alias("xml")))
    own = {c: f"_{c}" for c in both.columns}
    joined = front.join(both.withColumnsRenamed(own), F.col("doc_key") == F.col("_doc_key"), "left")
    first = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    filled = lambda c: F.coalesce(F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")), F.col(c)).alias(c)
    return joined.join(articles.select(F.col("doc_key").alias("_key"), F.col("xml").isNotNull().alias("has_fulltext")), F.col("doc_key") == F.col("_key")).select(
        "doc_key", first("pmid"), F.lit(None).cast("string").alias("pmcid"), first("title"), filled("authors").cast("array<struct<family:string,given:string>>").alias("authors"), first("journal"), first("year"), first("volume"), "issue", first("pages"), first("doi"), first("abstract"),
        "keywords", F.col("_pub_types").alias("pub_types"), "has_fulltext", "tags",
    )


def library_rows(blocks: DataFrame, papers: DataFrame, model: str, tokenizer: str | None = None) -> DataFrame:
    """Rows of the library: chunks for the model, figures, and the abstract of each paper. ``tokenizer``: the path of the model's own, whose tokens then bound a chunk instead of words."""
    key = F.col("doc_key")
    number = lambda n: (F.crc32("doc_key") * PAPER + n).cast("long").alias("seq")
    none = F.lit(None).cast("string")

    def row(df: DataFrame, kind: str, n: Column, type_: str, text: Column, section: Column, first: int) -> DataFrame:
        return df.select(F.concat(key, F.lit(f"::{kind}::"), n.cast("string")).alias("id"), "doc_key", F.lit(type_).alias("type"), text.alias("text"), X.nullif_empty(section).alias("section"), number(first + n))

    order = F.row_number().over(Window.partitionBy("doc_key").orderBy("pos")) - 1
    figures = blocks.where("kind = 'figure'").withColumn("n", order)
    chunks = section_chunks(blocks, words_for(model)) if tokenizer is None else token_chunks(blocks, tokenizer, P.MODEL_TOKENS.get(model, P.DEFAULT_TOKENS))
    rows = row(chunks, "text", F.col("chunk"), "text", F.col("text"), F.col("heading"), 0)
    rows = rows.unionByName(row(figures, "fig", F.col("n"), "figure", F.coalesce(X.nullif_empty(F.col("text")), F.lit(NO_CAPTION)), F.col("heading"), FIGURES))
    rows = rows.unionByName(row(papers.where("abstract <> ''"), "abstract", F.lit(0), "abstract", F.col("abstract"), none, ABSTRACT))
    return rows.join(papers.select("doc_key", "pmid", "title", "tags"), "doc_key")
