"""SimHash near-duplicates: fingerprints, all pairs within a Hamming distance by segment popcounts, and near copies by Jaccard similarity.

A fingerprint is embedded as the bit counts of its 32 segments of two bits, side by side. A bit that differs moves one
count by one, so the Manhattan distance of two embeddings is at most the Hamming distance. Of fingerprints within distance 3
one half of 32 bits differs in one bit at most: a range join on the grid of each half's 16 counts, where a point meets
its own cell and the cells that lie one step up. The distance that this leaves for the other half bounds, in the join's own
condition, the Manhattan distance of that half's counts over segments of eight bits. What meets is held against the
Manhattan distance of all 32 counts, then verified bit by bit. Equal fingerprints are one point, so copies cost nothing.

A cell is shared by up to 2 ** 16 words of a half. Of pairs of unrelated fingerprints 7 in a million lie in cells that meet, 3 in ten
million pass the range condition and 5 in a hundred million all 32 counts (measured, see README).

A 64-bit fingerprint can't tell a Jaccard similarity of 0.8: such texts differ in ten bits, where a range of cells rules
nothing out. So ``near_copies``, which takes five words and a similarity of 0.8, holds fingerprints within DISTANCE bits to be candidates
only, adds those of MinHash bands, and verifies all on the whole sets of shingles.

Defined results: a null or empty text has no words and the fingerprint zero, which links like any other. A null doc_id
takes part in no minimum: a group of null ids alone has a null component. Repeated doc_ids are rows of one document if
their fingerprints differ: each row has the component of its own fingerprint. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import minhash
from quillstone.llm.common import LOWER, UPPER, WORD, components, materialise, release

#: Of the query: words a shingle, differing bits, seed.
SHINGLE, DISTANCE, SEED = 3, 3, 42
_TABLE = str.maketrans(UPPER, LOWER)
#: Shingles are hashed in blocks of so many, which bounds the memory of a very long text.
_BLOCK = 20_000


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].astype("<u8", copy=False)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def majority(sums: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are those that more than half of ``n`` hashes have."""
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = re.findall(WORD, (text or "").translate(_TABLE))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : min(at + _BLOCK, n) + shingle - 1]
        joined = [" ".join(part)] if len(part) < shingle else map(" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        total += bit_sums(np.array([xxh64_intdigest(s, seed) for s in joined], dtype="<u8"))
    return majority(total, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def rows(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, fp long")


_EVEN = 0x5555555555555555
_HALF = (1 << 32) - 1


def half_of(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(_HALF))


def counts(word: Column) -> Column:
    """The cell of a half: the counts of its 16 segments of two bits, two bits each."""
    even = F.lit(_EVEN & _HALF)
    return word.bitwiseAND(even) + F.shiftright(word, 1).bitwiseAND(even)


def coarse(word: Column, segment: int) -> Column:
    """The count of one of a half's four segments of eight bits."""
    return F.bit_count(word.bitwiseAND(F.lit(0xFF << 8 * segment)))


def coarse_distance(a: Column, b: Column) -> Column:
    """Manhattan distance of two halves' counts over segments of eight bits."""
    first, *rest = [F.abs(coarse(a, s) - coarse(b, s)) for s in range(4)]
    for d in rest:
        first = first + d
    return first


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the 32 segment counts: each count in unary (0, 01, 11), then the bits that differ."""

    def unary(x):
        y = F.shiftrightunsigned(x, 1)
        return x.bitwiseOR(y).bitwiseAND(F.lit(_EVEN)).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(F.lit(_EVEN)), 1))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def met_pairs(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct ``points.fp`` that meet in the grid of either half, the other half's counts being near enough; a pair may come twice."""
    if not 0 <= distance <= 3:
        raise ValueError("one of two halves differs in one bit at most up to distance 3 only")
    half = F.array(*[F.struct(F.lit(h).alias("half"), half_of(F.col("fp"), h).alias("near"), half_of(F.col("fp"), 1 - h).alias("far")) for h in (0, 1)])
    grid = points.select("fp", F.explode(half).alias("w")).select("fp", "w.half", "w.far", counts(F.col("w.near")).alias("cell"))
    # one bit more in a segment is one step up, where the segment isn't full
    up = [F.when(F.shiftright("cell", 2 * s).bitwiseAND(3) < 2, F.col("cell") + F.lit(1 << 2 * s)) for s in range(16)]
    cells = grid.select(F.col("fp").alias("a"), "half", "cell", F.col("far").alias("far_a"))
    probes = grid.select(F.col("fp").alias("b"), "half", F.col("far").alias("far_b"), F.posexplode(F.filter(F.array(F.col("cell"), *up), lambda c: c.isNotNull())).alias("step", "cell"))
    left = F.when(F.col("step") > 0, distance - 1).otherwise(distance)
    once = (F.col("step") > 0) | (F.col("a") < F.col("b"))
    return cells.join(probes, ["half", "cell"]).where(once & (coarse_distance(F.col("far_a"), F.col("far_b")) <= left)).select("a", "b")


def near_pairs(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs (a, b) of distinct ``points.fp`` within the Hamming distance, which is at most 3; a pair may come twice."""
    near = met_pairs(points, distance).where(manhattan(F.col("a"), F.col("b")) <= distance)
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links between fingerprints."""
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    points = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    links = materialise(near_pairs(points, distance), "links")
    # fingerprints are nodes; a component's smallest doc_id is then the least of its nodes' representatives
    comp = materialise(components(links), "components")
    linked = points.join(comp, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialise(linked.join(least, "component").select(F.col("fp").alias("_fp"), "component_id"), "named", points.count())
    release(points, links, comp)
    return fps.join(named, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def text_hashes() -> list[Column]:
    """Two hashes that a text is known by: of 10 billion texts some three pairs share one of them, and a pair both with a chance of one in 10 ** 18."""
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]


def near_copies(docs: DataFrame, similarity: float = minhash.SIMILARITY, shingle: int = minhash.SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(h, g, component) of each distinct text of ``docs``, known by two hashes: texts linked by a Jaccard similarity of their shingles share a component.

    Candidates are fingerprints within ``distance`` bits, and texts that share a MinHash band.
    """

    def signed(batches):
        for b in batches:
            sets = [minhash.shingles(t.as_py(), shingle, seed) for t in b.column(1)]
            fp = np.array([majority(bit_sums(s), len(s)) for s in sets], dtype=np.uint64).view(np.int64)
            bands = pa.array([minhash.bands_of(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), bands], names=["h", "g", "n", "fp", "bands"])

    texts = docs.select(*text_hashes(), "text")
    made = texts.select("h", "text", "g").mapInArrow(signed, "h long, g long, n long, fp long, bands array<long>")
    points = made.groupBy("h", "g").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    points = materialise(points.withColumn("p", F.monotonically_increasing_id()), "points")  # a number of its own
    # texts of one fingerprint are held against the least of them, near fingerprints by theirs
    of = materialise(points.groupBy("fp").agg(F.min(F.struct("p", "n")).alias("x"), F.count("*").alias("m")).select("fp", "x.p", "x.n", "m"), "fingerprints")
    end = lambda x: of.select(F.col("fp").alias(x), F.col("p").alias(f"p{x}"), F.col("n").alias(f"n{x}"))
    near = near_pairs(of, distance).join(end("a"), "a").join(end("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("na"), F.col("nb"))
    same = points.join(of.where("m > 1").select(F.col("fp").alias("_fp"), F.col("p").alias("a"), F.col("n").alias("na")), F.col("fp") == F.col("_fp")).where("p <> a")
    found = materialise(near.union(same.select("a", F.col("p").alias("b"), "na", F.col("n").alias("nb"))), "candidates")
    linked = minhash.linked(texts, points, found, similarity, shingle, seed)
    comp = materialise(components(linked), "components")
    out = materialise(points.select("p", "h", "g").join(comp, F.col("p") == F.col("node"), "left").select("h", "g", F.coalesce("component", "p").alias("component")), "copies")
    release(points, of, found, linked, comp)
    return out


def deduplicate(docs: DataFrame, similarity: float = minhash.SIMILARITY, shingle: int = minhash.SHINGLE) -> DataFrame:
    """One row of each component of ``near_copies``, with all its columns: that of the smallest doc_id, null ids last, then by the text's hash.

    So a text goes only for a near copy, never for another text of the same doc_id.
    """
    found = near_copies(docs, similarity, shingle)
    ids = docs.select(F.col("doc_id").alias("_id"), *text_hashes()).groupBy("h", "g").agg(F.min("_id").alias("_id"))
    # a text with an id goes before one without
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("h"), F.col("g"))).alias("best")
    keep = found.join(ids, ["h", "g"]).groupBy("component").agg(best).select(F.col("best.h").alias("_kh"), F.col("best.g").alias("_kg"), F.col("best._id").alias("_id"))
    keep = materialise(keep, "kept")
    release(found)
    h, g = text_hashes()
    same = docs.withColumns({"_h": h, "_g": g}).join(keep, (F.col("_h") == F.col("_kh")) & (F.col("_g") == F.col("_kg"))).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    one = Window.partitionBy("_h", "_g").orderBy("doc_id")
    return same.withColumn("_row", F.row_number().over(one)).where("_row = 1").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
