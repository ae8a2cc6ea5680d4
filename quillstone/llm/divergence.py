"""Source divergence audit: how far the words of each source of a language are from those of its other sources, and which words tell it.

Each language keeps the terms that at least LEAST_DOCS of its documents hold. A group (language, source) or a language gives a kept term the share
``p = 1 + floor(UNIT * (count + 1) / (N + V))`` of UNIT, N being its occurrences of kept terms and V the language's kept terms; p differs from q
by ``f = floor((p - q)**2 / q)``. Part ``pair`` has for each two sources of a language the sum of f over all kept terms, part ``term`` each source's TOP
terms with more than the language's share.

Documents are counted in tasks, lot by lot, before anything is shuffled: a lot's bytes are folded by a table and split, its terms numbered, and one sort of
numbers brings equal terms of a group and document together. Kept terms are dealt to blocks of about BLOCK by hash and the sources of a language to
about GROUPS; a task makes the dense int64 tile (sources by terms) of a block for two sets of sources, compares all their pairs by broadcasting, and
returns one partial sum a pair and the block's best terms of each source. Partial sums are added up by pair, best terms merged by
source. So a task's memory is bounded by BLOCK * GROUPS whatever the corpus holds, a hot source is a row of a tile like any other,
and what is shuffled of the pairs is a number for each of them and block.

All arithmetic is exact: shares are divided out three digits at a time, so no product leaves int64 below 9e15 occurrences.

Defined results: null text, lang and source count as empty strings. A group without kept terms has count 0 for all. A language without kept terms gives 0 for
its pairs and no terms. doc_ids aren't read: each row is a document. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, UPPER, materialise, release

UNIT_STEPS, LEAST_DOCS, TOP = 3, 3, 200
#: UNIT is a thousand for each step.
UNIT = 1000**UNIT_STEPS
BLOCK, GROUPS = 4096, 256
#: Rows that a task hands on at once, and elements of a product that is broadcast.
_SENT, _CELLS = 100_000, 1 << 21
#: Bytes of text, and rows, that a task counts at once.
LOT, LOT_ROWS = 1 << 24, 1 << 16
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 with a space in place of each byte outside terms, A-Z lower-cased.
_FOLD = bytes(x if x > 127 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(256))
#: Stands before a source's name where a row is for a group, not a term; no term holds it.
MARK = " "
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def lots(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(start, rows) of runs that hold LOT bytes, or one text, and LOT_ROWS rows at most."""
    lot, held, out = 0, 0, []
    for k, size in enumerate(sizes.tolist()):
        if k > lot and (held + size > LOT or k - lot == LOT_ROWS):
            out.append((lot, k - lot))
            lot, held = k, 0
        held += size
    return [*out, (lot, len(sizes) - lot)] if len(sizes) else out


def occurrences(texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, and sorted for each occurrence of one (group * terms + term) * texts + text."""
    words = pc.ascii_split_whitespace(pa.array([t.translate(_FOLD) for t in texts.cast(pa.large_binary()).to_pylist()], pa.string()))
    coded, text = words.flatten().dictionary_encode(), pc.list_parent_indices(words).to_numpy()
    out = groups[text]
    out *= len(coded.dictionary)
    out += coded.indices.to_numpy()
    out *= len(texts)
    out += text
    out.sort()
    return coded.dictionary, out


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value is another than the one before."""
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def term_counts(texts: pa.Array, langs: list[str], sources: list[str]) -> pa.RecordBatch:
    """COUNTS of a lot of rows without nulls."""
    codes: dict[tuple[str, str], int] = {}
    groups = np.array([codes.setdefault(g, len(codes)) for g in zip(langs, sources, strict=True)], np.int64)
    terms, found = occurrences(texts, groups)
    pair = found // max(1, len(texts))
    at = np.flatnonzero(changes(pair))
    n, docs = np.diff(at, append=len(pair)), np.add.reduceat(changes(found), at, dtype=np.int64)
    group, term = np.divmod(pair[at], max(1, len(terms)))
    real = term != pc.index(terms, "").as_py()  # splitting leaves one at a text's ends
    group, term, n, docs = (np.concatenate([x[real], y]) for x, y in zip((group, term, n, docs), (np.arange(len(codes)), len(terms) + np.arange(len(codes)), *[np.zeros(len(codes), np.int64)] * 2), strict=True))
    lang, source = (pa.array(x, pa.string()) for x in zip(*codes, strict=True))
    terms = pa.concat_arrays([terms, pc.binary_join_element_wise("", source, " ")])
    return pa.RecordBatch.from_arrays([lang.take(group := pa.array(group)), source.take(group), terms.take(pa.array(term)), pa.array(n), pa.array(docs)], schema=COUNTS)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each lot of rows; MARK and source in place of a term for each group."""

    def rows(batches):
        for b in batches:
            langs, sources = (b.column(k).to_pylist() for k in (1, 2))
            for start, size in lots(pc.binary_length(b.column(0)).to_numpy()):
                own = slice(start, start + size)
                out = term_counts(b.column(0)[own], langs[own], sources[own])
                yield from (out.slice(k, _SENT) for k in range(0, len(out), _SENT))

    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return read.mapInArrow(rows, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, all_n, first): counts of kept terms by source and over all, ``first`` being 1 once a language and term; and the groups, with MARK.

    What tasks counted is dealt by language and term once, for the sums by source as for those over all.
    """
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")  # a row for each source
    all_of = sums.withColumns({"all_n": F.sum("n").over(of), "docs": F.sum("docs").over(of), "first": (F.min("source").over(of) == F.col("source")).cast("long")})
    return all_of.where((F.col("docs") >= least_docs) | F.col("term").startswith(MARK)).drop("docs")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly; count + 1 is at most ``total``."""
    total = np.broadcast_to(np.asarray(total, np.int64), count.shape)
    if total.max(initial=0) > np.iinfo(np.int64).max // 1000:
        raise ValueError("too many occurrences to divide in 64 bits")
    out, rest = np.zeros_like(count), count + 1
    for _ in range(UNIT_STEPS + 1):  # the first step gives what is 1 already
        digit, rest = np.divmod(rest, total)
        out, rest = out * 1000 + digit, rest * 1000
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of ``p`` and each of ``q`` the sum of ``apart`` over all terms, some rows broadcast at a time."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, _CELLS // max(1, q.size))
    for at in range(0, len(p), step):
        out[at : at + step] = apart(p[at : at + step, None], q[None]).sum(2)
    return out


def tiles(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): partial sums of pairs, and the best terms of a block, from rows dealt to (lang, block, i, j).

    Rows with a term are counts (source, term, n, all_n), those without are the groups themselves (source, total, all_total, terms: the block's number of kept
    terms); both hold ``v``, and ``own``, i or j. Terms of the block that neither set of sources holds have no row, but count.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def tile(t: pa.Table) -> pa.Table:
        lang, i, j = (t.column(c)[0].as_py() for c in ("lang", "i", "j"))
        counts, groups = t.filter(pc.is_valid(t.column("term"))), t.filter(pc.is_null(t.column("term")))
        names = groups.column("source").to_pylist()
        own = groups.column("own").to_numpy()
        terms = pc.unique(counts.column("term"))
        terms = terms.take(pc.sort_indices(terms))  # by UTF-8, so that ties come in this order
        shape = len(names), len(terms)
        row = pc.index_in(counts.column("source"), groups.column("source").combine_chunks()).to_numpy()
        column = pc.index_in(counts.column("term"), terms).to_numpy()
        n, all_n = np.zeros(shape, np.int64), np.zeros(len(terms), np.int64)
        n[row, column] = counts.column("n").to_numpy()
        all_n[column] = counts.column("all_n").to_numpy()
        rest = groups.column("terms")[0].as_py() - len(terms)  # terms of the block that only other sets' sources hold
        none = np.ones((len(names), min(rest, 1)), np.int64)
        if groups.column("terms")[0].as_py():
            v = groups.column("v")[0].as_py()
            p = share(n, (groups.column("total").to_numpy() + v)[:, None])
            q = share(all_n, groups.column("all_total")[0].as_py() + v)
            none = share(none - 1, (groups.column("total").to_numpy() + v)[:, None])
        else:
            p, q = np.ones(shape, np.int64), np.ones(0, np.int64)
        x, y = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        sources, items, values, parts = [], [], [], []
        for a, b in [(x, y)] if i == j else [(x, y), (y, x)]:
            found = pair_sums(p[a], p[b]) + rest * pair_sums(none[a], none[b])
            r, c = np.nonzero(a[:, None] != b[None])
            sources += [names[k] for k in a[r]]
            items += [names[k] for k in b[c]]
            values.append(found[r, c])
        parts += ["pair"] * len(sources)
        if i == j:
            for k in range(len(names)):
                at = np.nonzero((n[k] > 0) & (p[k] > q))[0]
                f = apart(p[k, at], q[at])
                best = np.argsort(-f, kind="stable")[:top]
                sources += [names[k]] * len(best)
                items += terms.take(pa.array(at[best])).to_pylist()
                values.append(f[best])
                parts += ["term"] * len(best)
        return pa.table([pa.array(c, f.type) for c, f in zip(([lang] * len(sources), sources, parts, items, np.concatenate(values)), schema, strict=True)], schema=schema)

    return rows.groupBy("lang", "block", "i", "j").applyInArrow(tile, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    stored, mark = materialise(kept_terms(docs, least_docs), "kept-terms"), F.col("term").startswith(MARK)
    kept = stored.where(~mark)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("v"))
    named = stored.where(mark).select("lang", "source").join(totals, ["lang", "source"], "left")
    named = materialise(named.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    lang = named.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("total").alias("all_total"), F.count("*").alias("sources"))
    parts = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
    lang = materialise(lang.select("lang", "v", "all_total", parts("v", block).alias("blocks"), parts("sources", groups).alias("sets")), "languages")
    none = F.lit(None)
    dealt = kept.join(lang, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    terms = dealt.where("first = 1").groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = named.drop("v").join(lang, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(terms, ["lang", "block"], "left")
    every = every.select("lang", "source", none.cast("string").alias("term"), none.cast("long").alias("n"), none.cast("long").alias("all_n"), "total", "all_total", "v", F.coalesce("terms", F.lit(0)).alias("terms"), "sets", "block")
    at = dealt.select("lang", "source", "term", "n", "all_n", none.cast("long").alias("total"), none.cast("long").alias("all_total"), "v", none.cast("long").alias("terms"), "sets", "block")
    rows = every.union(at).withColumn("own", F.pmod(F.xxhash64("source"), F.col("sets")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "sets")
    found = materialise(tiles(rows, top), "tiles")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", ranked)
    best = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    release(stored, named)
    return pairs.union(best).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + ({UNIT} * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v) AS BIGINT) AS p, CAST(1 + ({UNIT} * (k.n + 1)) // (v.n + v.v) AS BIGINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
