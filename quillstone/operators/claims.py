"""Claim checks and triage decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X


def validate(claims: DataFrame, check_span: bool = True, check_numbers: Column | bool = True) -> DataFrame:
    """Adds error: the first check that fails of rows (text, src array, direction, span), or null."""
    direction = X.structured(F.col("direction"))
    error = F.when(direction.isNotNull() & ~direction.isin(X.DIRECTIONS), "invalid_direction")
    if check_span:
        error = error.when(F.coalesce(F.trim("span") == "", F.lit(True)), "missing_evidence_span").when(~X.span_in(F.col("span"), F.col("src")), "evidence_span_not_in_source")
    numbers = check_numbers if isinstance(check_numbers, Column) else F.lit(check_numbers)
    bad = F.size(X.missing_numbers(F.col("text"), F.array_join("src", " "))) > 0
    return claims.withColumn("error", error.when(numbers & bad, "numbers_not_in_source"))


DECISIONS = "decisions array<struct<pmid:string,included:boolean,reason:string>>"


def triage_json(decisions: DataFrame, parts: int = 64) -> DataFrame:
    """Decision files, one JSON a row: as many as ``parts``, dealt by a hash of pmid."""
    part = F.pmod(F.xxhash64("pmid"), F.lit(parts))
    return decisions.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("pmid", "included", "reason")).alias("decisions"))).alias("json")).select("json")


def included_from_json(files: DataFrame) -> DataFrame:
    return files.select(F.explode(F.from_json("json", DECISIONS)["decisions"]).alias("x")).where("x.included").select("x.pmid")


def triage_summary(t: DataFrame) -> DataFrame:
    out = ~F.col("included")
    return t.agg(F.count("*").alias("total"), F.count_if("included").alias("included"), F.count_if(out).alias("excluded"), F.count_if(out & (F.coalesce("reason", F.lit("")) != "")).alias("with_reason"))


def screen(papers: DataFrame) -> DataFrame:
    return papers.withColumn("kept", F.coalesce(F.length(F.trim("title")) > 0, F.lit(False)))


def search(papers: DataFrame, needle: str, journal: str | None = None, year: str | None = None) -> DataFrame:
    out = papers if journal is None else papers.where(F.col("journal") == journal)
    out = out if year is None else out.where(F.col("year") == year)
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.transform("authors", lambda a: a["family"]), " "))
    return out.where(F.contains(F.lower(hay), F.lit(needle.lower())))


def to_ingest(decisions: DataFrame, library: DataFrame) -> DataFrame:
    """Included records: those already in the library only join the project, the others are to be ingested."""
    have = library.distinct()
    inc = decisions.where("included").select("pmid")
    return inc.join(have, F.col("pmid") == F.col("doc_key"), "left").select("pmid", F.when(F.col("doc_key").isNull(), "ingest").otherwise("join").alias("action"))


def fallback(docs: DataFrame) -> DataFrame:
    """The best source there is of rows (doc_id, pkg, xml, pdf)."""
    best = F.coalesce("pkg", "xml", "pdf")
    return docs.select("doc_id", F.coalesce(best, F.lit("metadata")).alias("source"), best.isNotNull().alias("has_fulltext"))
