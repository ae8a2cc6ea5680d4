"""Texts of a Jaccard similarity: the part of near-copy detection that 64-bit fingerprints can't reach.

Texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least 0.8. After Broder (1997): BANDS
bands of ROWS minima each; texts that agree in a whole band meet in its bucket. A pair of similarity s misses all bands with
probability (1 - s ** ROWS) ** BANDS, 3 in a million at 0.8 and less above, at any size of the input. What meets is verified on
the whole sets, so nothing below the threshold is linked.

Of a bucket first each text is held against the one that meets most others in all its buckets, as an original does among
its copies. Buckets that then still hold several components are compared whole, by blocks of texts: a task counts the
shingles that two blocks share as a product of matrices and returns what its links connect. So a group of near copies
costs about a comparison a text, no pair that could change a component is left out, and no pair is a row of its own.

Defined results: a null or empty text has no shingles, and such texts are copies of each other. A text of fewer than five
words is one shingle. A text is known by two 64-bit hashes. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, UPPER, WORD, components, forest, materialise, release, shared_counts

SHINGLE, SIMILARITY, ROWS, BANDS, SEED = 5, 0.8, 5, 32, 42
_TABLE = str.maketrans(UPPER, LOWER)
#: Minima are taken over so many shingles at a time, which bounds the memory of a very long text.
_BLOCK = 2_000
#: A block of a bucket holds about so many shingles; a matrix in a task so many rows and columns at most.
BLOCK_SHINGLES, _ROWS = 1 << 18, 256


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = re.findall(WORD, (text or "").translate(_TABLE))
    if not words:
        return np.zeros(0, np.uint64)
    joined = [" ".join(words)] if len(words) < shingle else map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in joined), np.uint64))


def bands_of(hashes: np.ndarray, rows: int = ROWS, bands: int = BANDS, seed: int = SEED) -> np.ndarray:
    """A number for each band: its place and minima hashed."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(seed)
    by, plus = rng.integers(0, 2**63, (2, rows * bands, 1), dtype=np.uint64)
    by |= np.uint64(1)
    least = np.full(rows * bands, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[at : at + _BLOCK] * by + plus).min(1))
    return np.array([xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(least.reshape(bands, rows))], np.uint64).view(np.int64)


def connected(x: list[tuple[int, int, np.ndarray]], y: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Pairs of ids that connect what the links between texts (id, component, set) of ``x`` and ``y`` connect."""
    out: set[tuple[int, int]] = set()
    for i in range(0, len(x), _ROWS):
        for j in range(0, len(y), _ROWS):
            a, b = x[i : i + _ROWS], y[j : j + _ROWS]
            shared = shared_counts([t[2] for t in a], [t[2] for t in b]).astype(float)
            union = np.array([len(t[2]) for t in a])[:, None] + np.array([len(t[2]) for t in b])[None] - shared
            links = (shared / np.maximum(union, 1) >= similarity) | (union == 0)
            links &= np.array([t[1] for t in a])[:, None] != np.array([t[1] for t in b])[None]
            ids = [t[0] for t in a] + [t[0] for t in b]
            out.update((ids[m], ids[k]) for k, m in enumerate(forest(links)) if ids[k] != ids[m])
    return sorted(out)


def across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between texts of different components in the same bucket, of rows (k, p, n, c); two blocks of a bucket meet in one task."""
    sized = members.groupBy("k").agg(F.ceil((F.sum("n") + 1) / BLOCK_SHINGLES).cast("int").alias("blocks"), F.sum(F.xxhash64("p").cast("decimal(38,0)")).alias("same"), F.count("*").alias("m"))
    # buckets of the same texts are compared once
    sized = sized.groupBy("same", "m").agg(F.min(F.struct("k", "blocks")).alias("x")).select(F.col("x.k").alias("_k"), "x.blocks")
    own = F.pmod(F.xxhash64("p", F.lit("block")), F.col("blocks")).cast("int")
    at = members.join(sized, F.col("k") == F.col("_k")).select("k", "p", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    at = at.select("k", "p", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    at = at.join(sets, "p")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rows = list(zip(t.column("p").to_pylist(), t.column("c").to_pylist(), (s.values.to_numpy() for s in t.column("shingles")), t.column("own").to_pylist(), strict=True))
        x, y = ([r[:3] for r in rows if r[3] == k] for k in (i, j))
        found = connected(x, y, similarity)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return at.groupBy("k", "i", "j").applyInArrow(compare, "a long, b long")


def linked(texts: DataFrame, points: DataFrame, candidates: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """(a, b): links that make the components of all texts of the similarity; a table.

    ``texts`` (h, g, text), ``points`` (p, h, g, n, bands), ``candidates`` (a, b, na, nb) besides those of the bands; n: the size of a text's set.
    """
    at = points.select("p", "n", F.explode("bands").alias("k"))
    shared = at.groupBy("k").agg(F.count("*").alias("met")).where("met > 1").select(F.col("k").alias("_k"), "met")
    met = materialise(at.join(shared, F.col("k") == F.col("_k")).select("k", "p", "n", "met"), "buckets")
    often = met.groupBy("p").agg(F.sum("met").alias("often"))
    met2 = materialise(met.drop("met").join(often, "p"), "buckets")
    release(met)
    met = met2
    middle = met.groupBy("k").agg(F.max(F.struct("often", "p", "n")).alias("x")).select(F.col("k").alias("_k"), F.col("x.p").alias("a"), F.col("x.n").alias("na"))
    held = met.join(middle, F.col("k") == F.col("_k")).where("p <> a").select("a", F.col("p").alias("b"), "na", F.col("n").alias("nb"))
    low = F.least("a", "b") == F.col("a")
    pairs = held.union(candidates.select("a", "b", "na", "nb"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    # sizes that are too far apart rule a pair out
    pairs = materialise(pairs.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6).distinct(), "pairs")
    own = met.select("p").union(pairs.select("a")).union(pairs.select("b")).distinct()

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle, seed).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["p", "shingles"])

    # copies of a text become one row before they are dealt out
    wanted = points.select("p", "h", "g").join(own, "p", "left_semi")
    sets = texts.groupBy("h", "g").agg(F.first("text").alias("text")).join(wanted, ["h", "g"]).select("p", "text")
    sets = materialise(sets.mapInArrow(whole, "p long, shingles array<long>"), "sets")
    of = lambda c: sets.select(F.col("p").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = F.when(F.col("na") + F.col("nb") == 0, True).otherwise(both / (F.col("na") + F.col("nb") - both) >= similarity)
    links = materialise(pairs.join(of("a"), "a").join(of("b"), "b").where(alike).select("a", "b"), "links")
    first = materialise(components(links), "components")
    named = materialise(met.join(first, F.col("p") == F.col("node"), "left").select("k", "p", "n", F.coalesce("component", "p").alias("c")), "named")
    mixed = named.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select(F.col("k").alias("_k"))
    left = materialise(named.join(mixed, F.col("k") == F.col("_k"), "left_semi"), "mixed")
    out = materialise(links.union(across(left, sets, similarity)), "linked")
    release(met, pairs, sets, links, first, named, left)
    return out
