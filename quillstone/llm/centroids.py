"""Centroid clustering: Lloyd's rounds over whole-number vectors, filtered by kd-trees.

After Kanungo et al. (2002). Vectors become whole numbers, floor(SCALE * x) by component. Each task cuts its rows into lots of at most LOT
vectors and builds a kd-tree over each, once: a node halves its vectors at the median of its widest component and holds their number, their
componentwise sum and their box. Trees are rows of a table in the shared folder, which all rounds read. A round takes the
centroids down each tree, a level at a time: of a node's candidates, that nearest to the box's middle is the yardstick, and a candidate to which no
place of the box is as near as to the yardstick is dropped; so ties are never decided by pruning. A node with one candidate left gives its number and sum as a
whole; leaves compare their vectors with the candidates left, ties going to the smaller number.

All arithmetic is on whole numbers: int64, or doubles where every product and sum stays below 2**53. The driver holds the centroids only: a number for
each component of ``k`` of them.

Defined results: vectors that are null, hold null or non-finite components or don't have ``dim`` of them are left out. Null and repeated vec_ids
are rows of their own; a null vec_id is never a first centroid. With fewer than ``k`` vectors there are as many centroids. A component
of more than MOST in size raises ValueError, as squared distances wouldn't fit into long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, release

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
LOT, LEAF = 2048, 32
#: Largest component after scaling: sums of 2 * DIM squares of twice as much fit into 63 bits.
MOST = 1 << 27
#: Up to this size products of doubles are exact: DIM * 2 * SMALL**2 stays below 2**53.
SMALL = 1 << 22
TREE = "ids array<long>, points binary, low binary, high binary, sums binary"


def levels_of(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(n / leaf))) if n else 0


def starts_of(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level start among the tree's vectors."""
    return n * np.arange(1 << level, dtype=np.int64) >> level


def grow(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The order of the vectors in the tree, and for each level (low, high, sums) of its nodes, which hold equal numbers of vectors but for one."""
    n, depth = len(v), levels_of(len(v), leaf)
    order, nodes = np.arange(n), []
    for level in range(depth + 1):
        at = starts_of(n, level)
        own = v[order]
        low, high = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
        nodes.append((low, high, np.add.reduceat(own, at)))
        if level < depth:
            widest = (high - low).argmax(1)
            for a, b, m, c in zip(at, [*at[1:], n], starts_of(n, level + 1)[1::2], widest, strict=True):
                order[a:b] = order[a:b][np.argpartition(own[a:b, c], m - a)]
    return order, nodes


class Tree:
    """A kd-tree as it is stored: vectors in the tree's order, boxes and sums of its nodes, level by level."""

    def __init__(self, points: bytes, low: bytes, high: bytes, sums: bytes, dim: int):
        self.v = np.frombuffer(points, "<i4").reshape(-1, dim).astype(np.int64)
        self.low, self.high, self.sums = (np.frombuffer(x, t).reshape(-1, dim).astype(np.int64) for x, t in ((low, "<i4"), (high, "<i4"), (sums, "<i8")))
        self.depth = (len(self.low) + 1).bit_length() - 2

    def filtered(self, z: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, nodes, their only candidate, None) of whole nodes, and (level, leaves, None, their candidates) for what is left."""
        zz = (z * z).sum(1)
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        for level in range(self.depth + 1):
            low, high = (x[nodes + (1 << level) - 1] for x in (self.low, self.high))
            middle = (low + high)[:, None].astype(float) - 2.0 * z[None]
            best = np.where(may, (middle * middle).sum(2), np.inf).argmin(1)
            to = z[None] - z[best][:, None]
            # how much nearer than the yardstick the candidate is, twice over, at the corner that suits it best
            gain = 2 * (np.where(to > 0, high[:, None], low[:, None]) * to).sum(2) + zz[best][:, None] - zz[None]
            may &= gain >= 0
            one = may.sum(1) == 1
            yield level, nodes[one], best[one], None
            nodes, may = nodes[~one], may[~one]
            if not len(nodes):
                return
            if level == self.depth:
                yield level, nodes, None, may
            else:
                nodes, may = np.repeat(nodes * 2, 2), np.repeat(may, 2, 0)
                nodes[1::2] += 1

    def rows(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' vectors, and which of the nodes each is of."""
        n = len(self.v)
        at, to = n * nodes >> level, n * (nodes + 1) >> level
        size = to - at
        of = np.repeat(np.arange(len(nodes)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + at[of], of

    def resolved(self, level: int, leaves: np.ndarray, may: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the leaves' vectors, and the nearest candidate of each."""
        rows, of = self.rows(level, leaves)
        return rows, np.where(may[of], squares(self.v[rows], z), np.iinfo(np.int64).max).argmin(1)

    def totals(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the sum of each centroid's vectors."""
        n, sums = np.zeros(len(z), np.int64), np.zeros_like(z)
        for level, nodes, only, may in self.filtered(z):
            if may is None:
                np.add.at(n, only, (len(self.v) * (nodes + 1) >> level) - (len(self.v) * nodes >> level))
                np.add.at(sums, only, self.sums[nodes + (1 << level) - 1])
            else:
                rows, nearest = self.resolved(level, nodes, may, z)
                n += np.bincount(nearest, minlength=len(z))
                for c in np.unique(nearest):
                    sums[c] += self.v[rows[nearest == c]].sum(0)
        return n, sums

    def assigned(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector, and its squared distance."""
        out = np.zeros(len(self.v), np.int64)
        for level, nodes, only, may in self.filtered(z):
            if may is None:
                rows, of = self.rows(level, nodes)
                out[rows] = only[of]
            else:
                rows, nearest = self.resolved(level, nodes, may, z)
                out[rows] = nearest
        return out, ((self.v - z[out]) ** 2).sum(1)


def squares(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of vectors and centroids."""
    if max(np.abs(v).max(initial=0), np.abs(z).max(initial=0)) <= SMALL:
        product = (v.astype(float) @ z.astype(float).T).astype(np.int64)
    else:
        product = v @ z.T
    return (v * v).sum(1)[:, None] - 2 * product + (z * z).sum(1)[None]


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(good, F.lit(False)))


def whole(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    v = np.floor(scale * flat.reshape(-1, dim))
    if np.abs(v).max(initial=0) > MOST:
        raise ValueError(f"a component is larger than {MOST} after scaling")
    return v.astype(np.int64)


def forest_of(vectors: DataFrame, dim: int, scale: int, lot: int, leaf: int) -> DataFrame:
    """TREE rows of the usable vectors, written once."""

    def trees(batches):
        ids: list = []
        held: list[np.ndarray] = []
        n = 0

        def flush(keep: int):
            nonlocal ids, held, n
            v = np.concatenate(held)
            while len(v) > keep:
                own, v, mine, ids = v[:lot], v[lot:], ids[:lot], ids[lot:]
                order, nodes = grow(own, leaf)
                low, high, sums = (np.concatenate(x) for x in zip(*nodes, strict=True))
                cells = [[mine[k] for k in order], own[order].astype("<i4").tobytes(), low.astype("<i4").tobytes(), high.astype("<i4").tobytes(), sums.astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, [pa.list_(pa.int64()), *[pa.binary()] * 4], strict=True)], names=["ids", "points", "low", "high", "sums"])
            held, n = [v], len(v)

        for b in batches:
            if b.num_rows:
                ids += b.column(0).to_pylist()
                held.append(whole(b.column(1).flatten().to_numpy(zero_copy_only=False), dim, scale))
                n += b.num_rows
                if n >= lot:
                    yield from flush(lot - 1)
        if n:
            yield from flush(0)

    return materialise(vectors.mapInArrow(trees, TREE), "trees")


def _trees(batches, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].values, Tree(*(b.column(c)[k].as_py() for c in range(1, 5)), dim)


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The vectors of the smallest hashes of seed and vec_id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(k).collect()
    return np.stack([whole(np.array(r["embedding"]), dim, scale)[0] for r in rows]) if rows else np.zeros((0, dim), np.int64)


def moved(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the mean, or as they were where no vector is nearest."""
    k, dim = z.shape

    def part(batches):
        n, sums = np.zeros(k, np.int64), np.zeros_like(z)
        for _, tree in _trees(batches, dim):
            a, b = tree.totals(z)
            n, sums = n + a, sums + b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], names=["c", "n", "sums"])

    found = trees.mapInArrow(part, "c int, n long, sums array<long>").where("n > 0")
    rows = found.select("c", "n", F.posexplode("sums").alias("i", "s")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = z.copy()
    for r in rows:
        out[r["c"], r["i"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, lot: int = LOT, leaf: int = LEAF) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable row (vec_id, embedding)."""
    spark, vectors = vectors.sparkSession, usable(vectors, dim)
    z = first_centroids(vectors, k, seed, dim, scale)
    kinds = "vec_id long, cluster int, distance long"
    if not len(z):
        return spark.createDataFrame([], kinds + ", cluster_inertia long, inertia long, centroid_sha256 string")
    trees = forest_of(vectors, dim, scale, lot, leaf)
    for _ in range(rounds):
        was, z = z, moved(trees, z)
        if (was == z).all():
            break  # all later rounds are this one again

    def told(batches):
        for ids, tree in _trees(batches, dim):
            nearest, distance = tree.assigned(z)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = materialise(trees.mapInArrow(told, kinds), "assigned")
    release(trees)
    of = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z.tolist()]
    table = spark.createDataFrame([(c, s, sum(of.values()), marks[c]) for c, s in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle() -> str:
    """Rounds one after another; products of doubles are exact at the tables' sizes."""
    nearest = "a{n} AS MATERIALIZED (SELECT v.vec_id, v.e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.e, k, list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c) + list_dot_product(c, c) AS d FROM v, c{n}) v GROUP BY v.vec_id, v.e)"
    move = """c{m} AS MATERIALIZED (SELECT c{n}.k, coalesce(x.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT k, list(f ORDER BY i) AS c FROM (
  SELECT k, i, floor(sum(x) / count(*)) AS f FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY k, i) GROUP BY k) x USING (k))"""
    steps = [nearest.format(n=0)]
    for n in range(ROUNDS):
        steps += [move.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, e AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {K}),
{", ".join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)
"""


ORACLE = _oracle()
