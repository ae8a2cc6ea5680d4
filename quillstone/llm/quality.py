"""Quality rules: statistics of each text, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of white space made one space, trimmed) and hashed. For each host, here the
source, the distinct documents that hold a line are counted; copies of a text are one document. Lines in more than
``max(least_docs, share * the host's distinct documents)`` of them, but at most ``most_docs`` if that is given, are boilerplate and are
removed. The query's own limits, LEAST_DOCS and SHARE, are those of its SQL and rise with the host; CLEANING, for the pipeline, doesn't rise
above 20 documents, which is past where line frequencies of clean text thin out in a host of 1,700 or 18,000 documents alike. A document is rejected if its base
rules fail, or if it is depleted: fewer than MIN_WORDS words remain, or less than MIN_LEFT of its words.

Everything is DataFrame functions. Counts are pre-aggregated before they are shuffled, so a line that a third of the documents
share is a few rows; the lines above the limit, at most all lines / least_docs, go back by a join that Spark
broadcasts only while they are small.

Defined results: a null text has no words, fails the base rules, and is the same text as an empty one where a host's texts are counted. A null source is a host of its own. Null and
repeated doc_ids are rows like others. An empty table gives no rows. Columns of the input whose names clash with
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, UPPER, materialise, scratch

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
LEAST_DOCS, SHARE, MIN_LEFT = 20, 0.01, 0.3
#: Limits that catch a repeated line in a host of any size.
CLEANING = {"least_docs": 5, "share": 0.1, "most_docs": 20}
SYMBOLS = "#*$%&|<>"
#: White space that parts words.
SPACES = " \t\n\x0b\x0c\r"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def normalised(text: Column) -> Column:
    """A-Z lower-cased, white space but newlines made spaces; ``trimmed`` finishes each line."""
    other = SPACES.replace(" ", "").replace("\n", "")
    return F.translate(text, UPPER + other, LOWER + " " * len(other))


def trimmed(line: Column) -> Column:
    return F.trim(F.when(F.instr(line, "  ") > 0, F.regexp_replace(line, " {2,}", " ")).otherwise(line))


def base_stats(docs: DataFrame, own: list[Column]) -> DataFrame:
    """``own`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce("text", F.lit(""))
    symbols = F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACES, " " * len(SPACES)))) > 0)
    df = docs.select(*own, words_of(text).alias("_w"), lines.alias("_l"), symbols.cast("long").alias("n_symbols"))
    n = F.size("_w")
    window = F.transform("_w", lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, WINDOW)]))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.when(n >= WINDOW, F.slice(window, F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")),
    }).drop("_w", "_l")
    # only texts that repeat a window go on: (hash, place) in order, so that equal hashes lie side by side
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs)).drop("_h")
    again = lambda s, i: (F.get("_s", i - 1)["h"] == s["h"]) | (F.get("_s", i + 1)["h"] == s["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda s, i: F.coalesce(again(s, i), F.lit(False))), lambda s: s["i"]))).drop("_s")
    covered = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_structs(c: Column) -> Column:
    """Array of (h, n): hash and number of words of each normalised line that has a word."""
    norm = F.filter(F.transform(F.split(normalised(F.coalesce(c, F.lit(""))), "\n"), trimmed), lambda x: x != "")
    return F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.size(F.split(x, " "))).alias("n")))


#: A text within its host: two hashes stand for it.
TEXT = ["source", "_t", "_u"]


def text_hashes() -> list[Column]:
    """A null text is the same text as an empty one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def measure(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, base statistics, the text's hashes and its lines: what the rules need, from one pass."""
    own = [F.col(c) for c in docs.columns if c not in (*RESULTS, "bad_lines", "text")]
    hashes = [*(h.alias(c) for h, c in zip(text_hashes(), TEXT[1:], strict=True)), line_structs(F.col("text")).alias("_x")]
    return base_stats(docs, own + hashes)


def frequent_lines(measured: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int | None = None) -> DataFrame:
    """(source, h, n_docs): line hashes above their host's limit. Copies of a text are one document."""
    at = measured.select(*TEXT, F.explode(F.array_distinct(F.transform("_x", lambda x: x["h"]))).alias("h"))
    seen = at.distinct().groupBy("source", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > (least_docs if most_docs is None else min(least_docs, most_docs)))
    hosts = measured.select(*TEXT).distinct().groupBy(F.col("source").alias("_host")).agg(F.count("*").alias("_all"))
    limit = F.greatest(F.lit(least_docs), share * F.col("_all"))
    over = seen.join(hosts, F.col("source").eqNullSafe(F.col("_host"))).where(F.col("n_docs") > (limit if most_docs is None else F.least(limit, F.lit(most_docs))))
    return over.select("source", "h", "n_docs")


def verdicts(measured: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, most_docs: int | None = None) -> DataFrame:
    """Adds removed_words, kept and bad_lines (hashes of the lines to remove, null if none) to ``measured``."""
    frequent = materialise(frequent_lines(measured, least_docs, share, most_docs).select(F.col("source").alias("_f"), F.col("h").alias("_fh")), "frequent-lines")
    at = measured.select(*TEXT, F.explode(F.array_distinct(F.transform("_x", lambda x: x["h"]))).alias("h")).distinct()
    bad = at.join(frequent, (F.col("h") == F.col("_fh")) & F.col("source").eqNullSafe(F.col("_f")), "left_semi")
    bad = bad.groupBy(*[F.col(c).alias(f"_b{c}") for c in TEXT]).agg(F.collect_set("h").alias("bad_lines"))
    bad = materialise(bad, "bad-lines")
    out = measured.join(bad, same_text(measured, bad), "left")
    gone = F.aggregate(F.filter("_x", lambda x: F.array_contains("bad_lines", x["h"])), F.lit(0), lambda a, x: a + x["n"])
    out = out.withColumn("removed_words", F.when(F.col("bad_lines").isNull(), 0).otherwise(gone).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))
    return out.withColumn("kept", kept).select(*measured.columns, "removed_words", "kept", "bad_lines")


def same_text(df: DataFrame, bad: DataFrame) -> Column:
    return (df["_t"] == bad["_b_t"]) & (df["_u"] == bad["_b_u"]) & df["source"].eqNullSafe(bad["_bsource"])


def judge(docs: DataFrame, **limits) -> DataFrame:
    """RESULTS and the columns of ``docs`` but text."""
    measured = materialise(measure(docs), "measured")
    return verdicts(measured, **limits).drop("_x", "_t", "_u", "bad_lines")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, with their boilerplate lines taken out of text and all their columns.

    Texts without such lines stay as they are, byte for byte. Verdicts depend on host and text alone, so they go back by
    these, and only those that change something do.
    """
    with scratch(docs.sparkSession) as keep:
        told = verdicts(materialise(measure(docs.select("source", "text")), "measured"), **limits).where("NOT kept OR bad_lines IS NOT NULL")
        told = told.groupBy(*[F.col(c).alias(f"_b{c}") for c in TEXT]).agg(F.first("kept").alias("_kept"), F.first("bad_lines").alias("_bad"))
        told = keep(materialise(told, "verdicts"))
    df = docs.withColumns(dict(zip(TEXT[1:], text_hashes(), strict=True)))
    df = df.join(told, same_text(df, told), "left").where(F.coalesce("_kept", F.lit(True)))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_bad", F.xxhash64(trimmed(normalised(x)))))
    text = F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return df.withColumn("text", text).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *RESULTS)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
b AS (SELECT w.doc_id, source, text, CAST(len(w) AS BIGINT) AS n_words,
    length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
l AS (SELECT doc_id, source, text, l, len(string_split(l, ' ')) AS n FROM (SELECT doc_id, source, text,
    translate(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM d) WHERE l <> ''),
f AS (SELECT l.source, l.l FROM l JOIN (SELECT source, count(DISTINCT text) AS a FROM d GROUP BY 1) h USING (source)
  GROUP BY l.source, l.l, h.a HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.01 * h.a),
g AS (SELECT doc_id, sum(n) AS removed FROM l JOIN f USING (source, l) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - coalesce(removed, 0) >= 10 AND n_words - coalesce(removed, 0) >= 0.3 * n_words AS kept
FROM b LEFT JOIN g USING (doc_id)
"""
