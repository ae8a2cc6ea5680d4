"""Boolean concept queries: made of terms and clauses, which are rendered as a query string or as a column over the corpus, with a funnel of hit counts; searches at a service."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.sources.remote import PAGE, Client

#: Of each sensitivity: whether optional concepts count, and whether short single words do.
SENSITIVITIES = {"broad": (False, True), "balanced": (True, True), "precise": (True, False)}
SHORT = 4
MOST_RESULTS = 10_000
_BREAK = re.compile(r"\r\n?|\n")


@dataclass(frozen=True)
class Concept:
    name: str
    terms: list[str] = field(default_factory=list)
    required: bool = True
    expand: bool = True

    def __post_init__(self):
        if not self.name.strip() or not [t for t in self.terms if t.strip()]:
            raise ValueError("a concept needs a name and a term")


@dataclass(frozen=True)
class Term:
    """What is looked for, and in which field of a record."""

    words: tuple[str, ...]
    where: str

    @classmethod
    def of(cls, text: str, where: str) -> Term:
        return cls(tuple(X.unquoted(text).split()), where)

    def __str__(self) -> str:
        mark = '"' * (len(self.words) > 1)
        return f"{mark}{' '.join(self.words)}{mark}[{self.where}]"


@dataclass(frozen=True)
class Clause:
    """Terms of a concept, any of which will do."""

    concept: str
    terms: tuple[Term, ...]
    required: bool = True

    def __str__(self) -> str:
        either = " OR ".join(map(str, self.terms))
        return f"({either})" if len(self.terms) > 1 else either


def direct(text: str | None) -> str:
    """A query as it is, on one line."""
    if line := _BREAK.sub(" ", (text or "").strip()):
        return line
    raise ValueError("the query is empty")


def select(concepts: list[Concept], sensitivity: str = "balanced") -> list[Concept]:
    """The concepts that count: without optional ones where the sensitivity leaves them out, unless there are no others."""
    if sensitivity not in SENSITIVITIES:
        raise ValueError(f"sensitivity is one of {list(SENSITIVITIES)}")
    with_optional, _ = SENSITIVITIES[sensitivity]
    return [c for c in concepts if with_optional or c.required] or list(concepts)


def terms_of(concept: Concept, sensitivity: str = "balanced") -> list[str]:
    """Terms, the first of those equal but for case; short single words only where the sensitivity takes them or nothing else is left."""
    first = {t.lower(): t for t in reversed(concept.terms)}
    terms = sorted(first.values(), key=str.lower)
    _, with_short = SENSITIVITIES[sensitivity]
    return [t for t in terms if with_short or " " in t.strip() or len(t.strip()) > SHORT] or terms


def clauses(concepts: list[Concept], sensitivity: str = "balanced", headings: dict[str, str] | None = None) -> list[Clause]:
    """Of each concept that counts: the headings of its terms in order, then its terms."""
    out = []
    for c in select(concepts, sensitivity):
        found = {headings[t.lower()] for t in c.terms if t.lower() in headings} if headings and c.expand else set()
        terms = [Term.of(h, "MeSH Terms") for h in sorted(found)] + [Term.of(t, "Title/Abstract") for t in terms_of(c, sensitivity)]
        out.append(Clause(c.name, tuple(terms), c.required))
    return out


def compile_clauses(concepts: list[Concept], sensitivity: str = "balanced", headings: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(name, clause) of each concept that counts."""
    return [(c.concept, str(c)) for c in clauses(concepts, sensitivity, headings)]


def clause_rows(concepts: DataFrame, heads: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """(concept, clause) of rows (concept, terms, expand): ``clauses`` for any number of concepts, ``heads`` (term, heading) being joined where a concept expands."""
    _, with_short = SENSITIVITIES[sensitivity]
    term = F.trim(F.regexp_replace(F.regexp_replace(F.col("t"), '"', "'"), r"\s+", " "))
    each = concepts.select("concept", "expand", F.posexplode("terms").alias("pos", "t"))
    first = each.groupBy("concept", F.lower("t").alias("low")).agg(F.min_by("t", "pos").alias("t"), F.first("expand").alias("expand"))
    found = first.where("expand").join(heads.select(F.col("term").alias("low"), "heading"), "low").groupBy("concept").agg(F.array_sort(F.collect_set("heading")).alias("found"))
    own = first.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("low", term.alias("t")))).alias("own")).join(found, "concept", "left")
    long = F.filter("own", lambda x: F.lit(with_short) | F.contains(x["t"], F.lit(" ")) | (F.length(x["t"]) > SHORT))
    kept = F.transform(F.when(F.size(long) > 0, long).otherwise(F.col("own")), lambda x: x["t"])
    tagged = lambda c, field: F.transform(c, lambda t: F.concat(F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t), F.lit(f"[{field}]")))
    terms = F.concat(tagged(F.coalesce("found", F.array().cast("array<string>")), "MeSH Terms"), tagged(kept, "Title/Abstract"))
    either = F.array_join(terms, " OR ")
    return own.select("concept", F.when(F.size(terms) > 1, F.concat(F.lit("("), either, F.lit(")"))).otherwise(either).alias("clause"))


def within(query: str, language: str) -> str:
    return f"({query}) AND {language}[Language]"


def compile_query(concepts: list[Concept], sensitivity: str = "balanced", headings: dict[str, str] | None = None, language: str = "English") -> str:
    return within(" AND ".join(map(str, clauses(concepts, sensitivity, headings))), language)


def ask_service(
    client: Client, url: str, query: str | None = None, concepts: list[Concept] | None = None, sensitivity: str = "balanced", headings: dict[str, str] | None = None,
    most: int = 1000, page: int = PAGE, steps: bool = False, language: str = "English",
) -> dict:
    """A search from the request to its ids: compiled, paged through, and with ``steps`` counted concept by concept.

    Ids come once each in the order of the pages, at most ``most`` and MOST_RESULTS. Steps are the hits of the first concepts
    together, one request each but for the last, which is the search itself.
    """
    if (query is None) == (not concepts):
        raise ValueError("give either a query or concepts")
    parts = clauses(concepts, sensitivity, headings) if concepts else []
    so_far = [within(q, language) for q in (accumulate(map(str, parts), "{} AND {}".format) if parts else [direct(query)])]
    total, ids = 0, {}
    for total, found in client.pages(url, so_far[-1], most, page):
        ids |= dict.fromkeys(found)
    pmids = list(ids)[: min(most, MOST_RESULTS)]
    warnings = ["short single words are left out, which may cost hits"] if parts and sensitivity == "precise" else []
    warnings += ["without headings all terms are looked for in titles and abstracts"] if parts and headings is None else []
    warnings += [f"{len(pmids)} of {total} hits are returned"] if len(pmids) < total else []
    totals = [next(client.pages(url, q, 1, 1), (0, []))[0] for q in so_far[:-1]] if steps else []
    return {
        "query": so_far[-1], "pmids": pmids, "total_count": total, "returned_count": len(pmids), "truncated": len(pmids) < total, "warnings": warnings,
        "clauses": [{"concept": c.concept, "clause": str(c), "required": c.required} for c in parts],
        "funnel": [{"concept": c.concept, "query": q, "total_count": n} for c, q, n in zip(parts, so_far, [*totals, total], strict=True)] if steps and parts else [],
    }


def predicate(concept: Concept, text: Column, sensitivity: str = "balanced") -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms_of(concept, sensitivity)])


def matching(docs: DataFrame, concepts: list[Concept], sensitivity: str = "balanced", language: str = "en") -> DataFrame:
    tests = [predicate(c, F.col("text"), sensitivity) for c in select(concepts, sensitivity)]
    return docs.where(F.col("lang") == language).where(reduce(lambda a, b: a & b, tests))


def funnel(docs: DataFrame, concepts: list[Concept], sensitivity: str = "balanced", language: str = "en") -> DataFrame:
    """(step, concept, total_count): hits of the first concepts together, all steps in one pass."""
    chosen = select(concepts, sensitivity)
    tests = [predicate(c, F.col("text"), sensitivity) for c in chosen]
    sums = [F.count_if(reduce(lambda a, b: a & b, tests[: i + 1])).alias(f"s{i}") for i in range(len(tests))]
    one = docs.where(F.col("lang") == language).agg(*sums)
    steps = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(c.name).alias("concept"), F.col(f"s{i}").alias("total_count")) for i, c in enumerate(chosen)])
    return one.select(F.explode(steps).alias("x")).select("x.*")


def excluded(steps: DataFrame) -> DataFrame:
    """Hits that the next step takes away. Steps are as few as concepts."""
    return steps.withColumn("excluded", F.col("total_count") - F.lead("total_count").over(Window.orderBy("step")))


def pages_merged(pages: DataFrame, most: int = 1000) -> DataFrame:
    """(pos, pmid): ids of result pages in order, each once, at most ``most`` and MOST_RESULTS."""
    first = pages.groupBy("pmid").agg(F.min("pos").alias("first"))
    top = first.orderBy("first").limit(min(most, MOST_RESULTS))
    return top.select("pmid", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("pos"))


def heading_table(terms: DataFrame) -> DataFrame:
    """(term, heading): of descriptors that share a normalised term the first record counts."""
    return terms.groupBy(X.squash(F.col("term")).alias("term")).agg(F.min_by("heading", "record").alias("heading"))


def look_up(asked: DataFrame, headings: DataFrame) -> DataFrame:
    return asked.withColumn("_t", X.squash(F.col("term"))).join(headings.withColumnRenamed("term", "_k"), F.col("_t") == F.col("_k"), "left").drop("_t", "_k")
