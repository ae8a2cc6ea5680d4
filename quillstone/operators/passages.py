"""Which texts hold which passages, without holding each against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.versions import stored

#: Words that a passage is looked up by, and characters where it has fewer than three words. So many of those, with so many characters in all, are
#: held against all texts instead, which is cheaper.
GRAM, CHARS, FEW, FEW_CHARS = 5, 8, 1000, 100_000
#: So many pairs to verify, with so many characters of passages, are brought to the texts; for more the texts are shuffled.
MET, MET_CHARS = 1_000_000, 64_000_000


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def gram(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def grams(w: Column, n: int) -> Column:
    """Hashes of all runs of n words of a column of words (a column that is there, not made on the way: it is read for each word)."""
    each = F.transform(w, lambda x, i: gram([x, *[F.get(w, i + k) for k in range(1, n)]]))
    return F.when(F.size(w) >= n, F.slice(each, F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<bigint>"))


def verified(docs: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """Of the pairs met (doc_id, qid) those whose text holds the passage."""
    met = stored(met.select("doc_id", "qid").distinct().join(items.select("qid", "asked"), "qid"), "met")
    size = met.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("asked")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= MET and size["chars"] <= MET_CHARS
    return docs.join(F.broadcast(met) if few else met, "doc_id").where(F.contains("text", "asked")).select("doc_id", "qid").distinct()


def by_characters(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``holding``, for any number of passages: they meet texts by their first CHARS characters, or all where there are fewer."""
    cut = items.select("qid", "asked", F.split("asked", "").alias("c")).withColumn("n", F.when(F.col("asked") == "", 0).otherwise(F.least(F.lit(CHARS), F.size("c"))))
    letters = docs.select("doc_id", F.split("text", "").alias("c"))
    out = docs.select("doc_id").join(cut.where("n = 0").select("qid"), F.lit(True))  # its result is each text with each
    for n in range(1, CHARS + 1):
        key = cut.where(F.col("n") == n).select("qid", gram([F.get("c", F.lit(k)) for k in range(n)]).alias("g"))
        met = letters.select("doc_id", F.explode(F.array_distinct(grams(F.col("c"), n))).alias("g")).join(key, "g")
        out = out.unionByName(verified(docs, met, cut.where(F.col("n") == n)))
    return out


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, qid) of texts (doc_id, text) that hold a passage (qid, asked), character by character.

    The words inside a passage are whole words of a text that holds it. So texts and passages meet by the hash of the
    passage's second to sixth word, or of fewer where it is shorter, and what meets is verified. Passages of one or two words meet texts by their
    first characters, unless they are few. A passage without characters is in every text.
    """
    docs = docs.where("text IS NOT NULL")
    inside = items.where("asked IS NOT NULL").withColumn("w", words(F.col("asked"))).withColumn("n", F.least(F.lit(GRAM), F.size("w") - 2))
    sizes = sorted(r[0] for r in inside.select("n").distinct().collect())  # at most GRAM + 3 numbers
    out = None
    for n in sizes:
        own = inside.where(F.col("n") == n)
        if n < 1:
            size = own.agg(F.count("*").alias("n"), F.sum(F.length("asked")).alias("chars")).first()
            if size["n"] <= FEW and size["chars"] <= FEW_CHARS:
                part = docs.join(F.broadcast(own.select("qid", "asked")), F.contains("text", "asked")).select("doc_id", "qid")
            else:
                part = by_characters(docs, own)
        else:
            key = own.select("qid", gram([F.get("w", F.lit(k)) for k in range(1, n + 1)]).alias("g"))
            met = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(grams(F.col("w"), n))).alias("g")).join(key, "g")
            part = verified(docs, met, own)
        out = part if out is None else out.unionByName(part)
    return docs.select("doc_id").join(items.select("qid"), F.lit(False)) if out is None else out
