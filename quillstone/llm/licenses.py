"""License scans: an exact set-similarity join between license templates and blocks of every text.

After Chaudhuri et al. (2006) and Xiao et al. (PPJoin, 2008), with containment for Jaccard. A template is cut into clauses of at most STEP
words, a text into blocks: windows of 2 * STEP words, one at each multiple of STEP. So whatever stands within STEP words stands
whole in some block, however long the text or its lines are. A block matches a clause if it holds at least CONTAINMENT of the clause's
distinct words, and gives its text the template's label.

Words are ordered by the number of texts in the whole corpus that hold them, rarest first; only words of clauses matter. A clause of m words of which o have to
be there has a prefix of its m - o + 1 rarest words, and a block without a word of it can't match (prefix filter), nor can one
with fewer than o words of clauses (length filter). Of words that meet in the join those are dropped after which too few are
left in either set (positional filter). What is left is counted whole. All of it is DataFrame functions; the clauses' words are the
join's small side, bounded by the templates (MOST_CLAUSES), never by the corpus. Nothing is grouped by word, so a phrase that a third
of the texts hold is no hot key: only matches are shuffled, by row.

Phrases, the base, are counted at the places where their words stand one after another; score is the largest share of a clause's
words found, 1 where a phrase is.

Defined results: a null or empty text has no words, no places and the score 0. Null and repeated doc_ids are rows like others. An
empty table gives no rows. Columns of the input whose names clash with results are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, UPPER, ascii_lower, materialise

STEP, CONTAINMENT = 32, 0.9
#: Bounds the side of the join that is broadcast: STEP rows for a clause.
MOST_CLAUSES = 20_000
#: What parts words, once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

# Phrases of the contract, and wordings of public licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]


def clauses_of(templates: list[tuple[str, str]], step: int = STEP, containment: float = CONTAINMENT) -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, how many have to be there): templates cut into pieces of at most ``step`` words, the last one reaching back."""
    out = []
    for label, text in templates:
        words = text.split()
        for at in [*range(0, len(words) - step, step), max(0, len(words) - step)] if words else []:
            own = list(dict.fromkeys(words[at : at + step]))
            out.append((len(out), label, own, max(1, ceil(Fraction(str(containment)) * len(own)))))
    if len(out) > MOST_CLAUSES:
        raise ValueError(f"more than {MOST_CLAUSES} clauses")
    return out


def standing(words: list[str]):
    """Whether the words stand one after another from the k-th of _hits."""

    def whole(h: Column, k: Column) -> Column:
        ok = h["w"] == words[0]
        for j, w in enumerate(words[1:], 1):
            ok = ok & (F.get("_hits", k + j)["w"] == w) & (F.get("_hits", k + j)["i"] == h["i"] + j)
        return F.coalesce(ok, F.lit(False))

    return whole


def measure(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str], step: int) -> DataFrame:
    """The columns of ``docs`` but text, n_words, the base, and for each ``step`` words of the text those of the vocabulary (_parts, in order)."""
    own = [F.col(c) for c in docs.columns if c not in (*RESULTS, "text", "_row")]
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), NO_WORD), "")
    df = docs.select(*own, F.monotonically_increasing_id().alias("_row"), words.alias("_w"))
    n = F.size("_w")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.expr(f"CAST((size(_w) - 1) div {step} AS INT)"))).otherwise(F.array().cast("array<int>"))

    def part(k: Column) -> Column:
        listed = lambda w, i: F.when(w.isin(vocabulary), F.struct((k * step + i).alias("i"), w.alias("w")))
        return F.array_compact(F.transform(F.slice("_w", k * step + 1, F.lit(step)), listed))

    df = df.withColumns({"n_words": n.cast("long"), "_parts": F.transform(starts, part)}).drop("_w")
    df = df.withColumn("_hits", F.flatten("_parts"))
    for k, phrase in enumerate(phrases):
        df = df.withColumn(f"_p{k}", F.transform(F.filter("_hits", standing(phrase.split())), lambda h: h["i"]))
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    has = [F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    df = df.withColumns({
        "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"),
        "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*has)))), "_parts": F.transform("_parts", lambda p: F.transform(p, lambda h: h["w"])),
    })
    return df.drop("_hits", *[f"_p{k}" for k in range(len(phrases))])


def frequencies(measured: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first: by the number of texts of the corpus with the word. A count for each of its words comes to the driver."""
    seen = measured.select(F.explode(F.array_distinct(F.flatten("_parts"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def matches(measured: DataFrame, clauses: list[tuple[int, str, list[str], int]], order: list[str]) -> DataFrame:
    """(_row, block, clause, label, containment): every block, numbered from 0 in its text, with every clause that it contains."""
    spark, rank = measured.sparkSession, {w: k for k, w in enumerate(order)}
    fewest = min(o for *_, o in clauses)
    rows = []
    for number, label, words, o in clauses:
        own = sorted(words, key=rank.get)
        rows += [(w, i, len(own), o, own, number, label) for i, w in enumerate(own[: len(own) - o + 1])]
    prefix = spark.createDataFrame(rows, "w string, i int, m int, o int, own array<string>, clause int, label string")
    rare = sorted({r[0] for r in rows})
    has = lambda p: F.coalesce(F.exists(p, lambda w: w.isin(rare)), F.lit(False))

    def block(p: Column, k: Column) -> Column:
        after = F.coalesce(F.get("_parts", k + 1), F.array().cast("array<string>"))
        words = F.array_intersect(F.array(*map(F.lit, order)), F.concat(p, after))  # distinct, in the order of frequency
        return F.struct(k.alias("block"), F.when(has(p) | has(after), words).alias("words"))

    blocks = F.filter(F.transform("_parts", block), lambda b: F.coalesce(F.size(b["words"]) >= fewest, F.lit(False)))
    df = measured.select("_row", F.explode(blocks).alias("b")).select("_row", "b.block", "b.words")
    df = df.select("*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - (fewest - 1))).alias("j", "w"))
    df = df.join(F.broadcast(prefix), "w").where(F.least(F.col("m") - F.col("i"), F.size("words") - F.col("j")) >= F.col("o"))
    df = df.withColumn("shared", F.size(F.array_intersect("own", "words"))).where("shared >= o")
    return df.select("_row", "block", "clause", "label", (F.col("shared") / F.col("m")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, step: int = STEP, containment: float = CONTAINMENT) -> DataFrame:
    """RESULTS and the columns of ``docs`` but text."""
    clauses = clauses_of([(label, text.translate(str.maketrans(UPPER, LOWER))) for label, text in templates], step, containment)
    words = sorted({w for _, _, own, _ in clauses for w in own})
    measured = materialise(measure(docs, sorted({*words, *" ".join(phrases).split()}), phrases, step), "measured")
    none = F.array().cast("array<string>")
    if clauses:
        found = matches(measured, clauses, frequencies(measured, words))
        found = materialise(found.groupBy(F.col("_row").alias("_r")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_most")), "licensed")
        out = measured.drop("_parts").join(found, F.col("_row") == F.col("_r"), "left").drop("_r")
    else:
        out = measured.drop("_parts").withColumns({"_more": none, "_most": F.lit(None).cast("double")})
    out = out.withColumns({
        "base_labels": F.array_join("_base", ","), "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", none)))), ","),
        "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_most", F.lit(0.0))),
    })
    return out.select(*[c for c in out.columns if c not in ("_row", "_base", "_more", "_most", *RESULTS)], *RESULTS)


def found_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, step: int = STEP, containment: float = CONTAINMENT) -> DataFrame:
    """(columns of ``docs`` but text, first_word, clause, label, containment): each block and clause that match, the clause by its number in ``clauses_of``."""
    clauses = clauses_of(templates, step, containment)
    words = sorted({w for _, _, own, _ in clauses for w in own})
    measured = materialise(measure(docs, words, {" ".join(words[:1]): ""}, step), "measured")
    found = materialise(matches(measured, clauses, frequencies(measured, words)).distinct(), "blocks")
    own = [c for c in docs.columns if c not in ("text", "_row", "label", "containment", "clause", *RESULTS)]
    return found.join(measured.select("_row", *own), "_row").select(*own, (F.col("block") * step).cast("long").alias("first_word"), "clause", "label", "containment")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS MATERIALIZED (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM w),
ph(phrase, label) AS (VALUES {_values(list(PHRASES.items()))}),
run AS (SELECT doc_id, i, t, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, label, i AS pos FROM run JOIN ph ON phrase = t || ' ' || t1 OR phrase = t || ' ' || t1 || ' ' || t2 WHERE t IN ('cc', 'general', 'all')),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY 1),
cl(clause, label, m, o, t) AS (VALUES {_values([(k, label, len(own), o, t) for k, label, own, o in clauses_of(TEMPLATES) for t in own])}),
blk AS (SELECT DISTINCT doc_id, i // {STEP} - d AS k, t FROM tok, (VALUES (0), (1)) x(d) WHERE i // {STEP} >= d),
hit AS (SELECT doc_id, k, clause, label, count(*) / m AS c FROM blk JOIN cl USING (t) GROUP BY doc_id, k, clause, label, m, o HAVING count(*) >= o),
every AS (SELECT doc_id, label, true AS b FROM places UNION SELECT doc_id, label, false FROM hit),
lab AS (SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY 1),
best AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""
