"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other letters part tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def squash(c: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def slugify(c: Column, max_len: int = 40, default: str = "search") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.trim(F.substring(s, 1, max_len), F.lit("-")), F.lit("")), F.lit(default))


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


#: Values that say a structured field isn't set (fixed values).
UNSET = ["", "unknown", "n/a", "na", "none", "not reported", "not stated"]
#: Directions a claim may state (fixed values).
DIRECTIONS = ["increase", "decrease", "no_difference", "mixed"]
#: Words that a cite key passes over (fixed values).
STOPWORDS = ["the", "a", "an", "of", "in", "on", "and", "for", "to", "with", "is", "as"]


def structured(c: Column) -> Column:
    """A structured field: trimmed, null where it says that it isn't set."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(UNSET), t)


def span_in(span: Column, sources: Column) -> Column:
    """Whether the span occurs in one of the source texts, whatever its case and white space."""
    needle = squash(span)
    return F.coalesce((needle != "") & F.exists(sources, lambda s: F.contains(squash(s), needle)), F.lit(False))


#: What counts as a number in a claim (fixed pattern).
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def missing_numbers(text: Column, source: Column) -> Column:
    """Numbers of two characters or more that don't occur as whole numbers in the source, in order."""
    numbers = F.filter(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.length(n) >= 2)
    found = lambda n: F.regexp_like(source, F.concat(F.lit("(^|[^0-9.])"), F.replace(n, F.lit("."), F.lit("[.]")), F.lit("([^0-9]|$)")))
    return F.filter(numbers, lambda n: ~found(n))


def year_of(c: Column) -> Column:
    """The four digits that the value starts with, else the value."""
    return F.coalesce(nullif_empty(F.regexp_extract(c, r"^([0-9]{4})", 1)), c)


#: What a DOI looks like (fixed pattern).
DOI = r"(10\.[0-9]{4,9}/[^\s\"'<>)]+)"


def doi_of(c: Column) -> Column:
    return nullif_empty(F.rtrim(F.regexp_extract(c, DOI, 1), F.lit(".,;")))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unquoted(text: str) -> str:
    """A quotation mark would end a phrase of a query."""
    return text.replace('"', "'")


def escape_term(c: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit('"'), F.lit("'"))


def field_tag(c: Column, tag: str) -> Column:
    t = escape_term(c)
    return F.concat(F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t), F.lit(f"[{tag}]"))


#: Headings of sections that aren't chunked (fixed pattern).
SKIPPED = r"(?i)^(references?|bibliography|reference list|abstract)$"


def skipped_section(c: Column) -> Column:
    """Whether a part of the heading path is a reference list or an abstract."""
    return F.coalesce(F.exists(F.split(c, " > "), lambda p: F.trim(p).rlike(SKIPPED)), F.lit(False))


def human_mb(c: Column) -> Column:
    mb = c / F.lit(1024.0 * 1024.0)
    return F.when(mb < 0.1, "< 0.1 MB").otherwise(F.format_string("%.1f MB", mb))


def html_text(c: Column) -> Column:
    """Text of an HTML page: scripts, styles and comments go, tags become spaces, common entities are undone."""
    t = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
