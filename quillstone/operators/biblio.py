"""Bibliographic filters, citation keys and BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import STOPWORDS


def _has(c: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))


def author_matches(authors: Column, name: str, position: str = "any") -> Column:
    """Whether the family name of the first, last or any author holds ``name``; another position means any."""
    if position in ("first", "last"):
        one = F.get(authors, F.lit(0)) if position == "first" else F.try_element_at(authors, F.lit(-1))
        return (F.size(authors) > 0) & _has(one["family"], name)
    return F.exists(authors, lambda a: _has(a["family"], name))


def author_position(authors: Column, name: str) -> Column:
    """first, last or middle, from the first author that matches; null without one."""
    at = F.array_position(F.transform(authors, lambda a: _has(a["family"], name)), True)
    return F.when(at == 1, "first").when((at > 1) & (at == F.size(authors)), "last").when(at > 1, "middle")


def year_between(year: Column, spec: str) -> Column:
    """``Y`` or ``Y-Y``; years that aren't whole numbers fail."""
    low, _, high = spec.partition("-")
    return F.coalesce(F.expr("try_cast(year AS INT)").between(int(low), int(high or low)), F.lit(False))


def any_holds(items: Column, needle: str) -> Column:
    return F.exists(items, lambda x: _has(x, needle))


def mine(papers: DataFrame, author: str | None = None, position: str = "any", year: str | None = None, journal: str | None = None, keyword: str | None = None, pub_type: str | None = None) -> DataFrame:
    """Papers that meet all filters given, with the author's position if one is."""
    out = papers
    if author:
        out = out.where(author_matches(F.col("authors"), author, position))
    if year:
        out = out.where(year_between(F.col("year"), year))
    if journal:
        out = out.where(_has(F.col("journal"), journal))
    if keyword:
        out = out.where(any_holds(F.col("keywords"), keyword))
    if pub_type:
        out = out.where(any_holds(F.col("pub_types"), pub_type))
    return out.withColumn("position", author_position(F.col("authors"), author)) if author else out


def authors_summary(authors: Column) -> Column:
    names = F.filter(F.transform(authors, lambda a: a["family"]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def last_author(authors: Column) -> Column:
    return F.try_element_at(F.filter(authors, lambda a: F.coalesce(a["family"] != "", F.lit(False))), F.lit(-1))["family"]


def initials(authors: Column) -> Column:
    """``Family AB`` of each author."""
    def one(a):
        first = F.array_join(F.transform(F.filter(F.split(F.coalesce(a["given"], F.lit("")), " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
        return F.trim(F.concat_ws(" ", a["family"], first))
    return F.array_join(F.transform(authors, one), ", ")


def base_key(authors: Column, year: Column, title: Column) -> Column:
    family = F.nullif(F.regexp_replace(F.lower(F.coalesce(F.get(authors, F.lit(0))["family"], F.lit(""))), "[^a-z0-9]", ""), F.lit(""))
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    word = F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(STOPWORDS)), F.lit(0)), F.get(words, F.lit(0)), F.lit("untitled"))
    return F.concat(F.coalesce(family, F.lit("unknown")), F.coalesce(F.nullif(year, F.lit("")), F.lit("nd")), word)


def character(code: Column) -> Column:
    """The character of a Unicode code point; ``char`` starts again at 256."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def cite_keys(papers: DataFrame, order: str) -> DataFrame:
    """Adds cite_key: the nth paper of a base key, n from 2, gets the letter a and on, by code points."""
    keyed = papers.withColumn("base", base_key(F.col("authors"), F.col("year"), F.col("title")))
    n = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return keyed.withColumn("_n", n).withColumn("cite_key", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", character(F.lit(95) + F.col("_n"))))).drop("_n")


def bibtex(keyed: DataFrame) -> Column:
    """The entry of rows with cite_key; unset fields are left out, and eid stands in for missing pages."""
    names = F.array_join(F.transform("authors", lambda a: F.regexp_replace(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(", "), F.coalesce(a["given"], F.lit(""))), "^[, ]+|[, ]+$", "")), " and ")
    has = lambda c: F.col(c) if c in keyed.columns else F.lit(None).cast("string")
    pages = F.nullif(has("pages"), F.lit(""))
    fields = [("author", names), ("title", has("title")), ("journal", has("journal")), ("year", has("year")), ("volume", has("volume")), ("number", has("issue")),
              ("pages", pages), ("eid", F.when(pages.isNull(), has("elocation_id"))), ("doi", has("doi")), ("pmid", has("pmid")), ("pmcid", has("pmcid"))]
    body = F.concat_ws(",\n", *[F.concat(F.lit(f"  {k} = {{"), F.nullif(v, F.lit("")), F.lit("}")) for k, v in fields])
    return F.concat(F.lit("@article{"), F.col("cite_key"), F.lit(",\n"), body, F.lit("\n}"))
