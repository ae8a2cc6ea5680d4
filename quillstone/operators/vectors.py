"""Approximate nearest vectors: a stored inverted file with product-quantised codes, and exact re-ranking.

After Jégou et al. (2011). Unit vectors are dealt to the nearest of some coarse centroids, each a folder of its own; what a vector differs from its centroid by
is kept as a code of one byte for each SUB components. A question reads the folders of the ``probes`` centroids nearest to it, and of
these the codes alone; the best REFINE * k by code are then looked up and compared exactly. Filters are applied before anything is ranked, so fewer than
``k`` rows are found only if the probed folders hold fewer; ``probes=None`` reads all folders and compares all vectors: the exact answer.

Centroids and code books are fitted on the driver on at most SAMPLE vectors, those of the least hashes of their ids; every vector is indexed. How
many lists a question needs is told by the sample (``Codes.needed``): few where vectors lie in groups, most where they lie evenly. How many of the true
neighbours are found is measured by ``recall``.

A null, zero or non-finite vector, or one of another length than the first in the sample, isn't indexed: it has no direction.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieval import number
from quillstone.sources.versions import Files

SAMPLE, SUB, CODES, ROUNDS, SEED = 20_000, 4, 256, 8, 7
#: Vectors of the sample for each centroid, at least; vectors compared exactly for each that is asked for.
PER_LIST, REFINE = 32, 10
#: Questions of the sample that tell how many lists have to be read, the neighbours looked for, and the part of them to be found.
TRIED, NEAR, COVERED = 256, 20, 0.95


def means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of at most ``k`` groups of rows by Lloyd's rounds; a centroid without rows stays where it was."""
    k = min(k, len(x))
    z = x[np.random.default_rng(seed).choice(len(x), k, replace=False)] if k else x[:0]
    for _ in range(rounds if k else 0):
        own = nearest(x, z)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(z)
        np.add.at(sums, own, x)
        z = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], z)
    return z


def nearest(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return ((z * z).sum(1)[None] - 2 * x @ z.T).argmin(1)


class Codes:
    """Coarse centroids (lists, dim), a code book for each SUB components, and how many lists a question has to read (probes)."""

    def __init__(self, lists: np.ndarray, books: list[np.ndarray], probes: int = 1):
        self.lists, self.books, self.dim, self.probes = lists, books, lists.shape[1], probes

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Codes:
        z = means(x, max(1, min(lists, len(x) // PER_LIST)))
        rest = x - z[nearest(x, z)]
        return cls(z, [means(rest[:, at : at + SUB], CODES, seed=SEED + at) for at in range(0, x.shape[1], SUB)], cls.needed(x, z))

    @staticmethod
    def needed(x: np.ndarray, z: np.ndarray) -> int:
        """The fewest lists that hold COVERED of the NEAR nearest of vectors of the sample, over TRIED of them as questions.

        In the whole table the nearest are nearer than in a sample of it, so there fewer would do.
        """
        q = np.random.default_rng(SEED).choice(len(x), min(TRIED, len(x)), replace=False)
        near = np.argsort(-(x[q] @ x.T), axis=1, kind="stable")[:, : min(NEAR, len(x))]
        place = np.argsort(np.argsort(-(x[q] @ z.T), axis=1, kind="stable"), axis=1)
        at = np.sort(np.take_along_axis(place, nearest(x, z)[near], 1).ravel())
        return int(at[math.ceil(COVERED * len(at)) - 1]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code (bytes) of each unit vector."""
        own = nearest(x, self.lists)
        rest = x - self.lists[own]
        return own, np.stack([nearest(rest[:, k * SUB : (k + 1) * SUB], b) for k, b in enumerate(self.books)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> list[int]:
        return np.argsort(-(self.lists @ q), kind="stable")[:probes].tolist()

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """What each entry of each book adds to the product with the question."""
        return [b @ q[k * SUB : (k + 1) * SUB] for k, b in enumerate(self.books)]

    def dumps(self) -> str:
        return json.dumps({"probes": self.probes, "lists": self.lists.tolist(), "books": [b.tolist() for b in self.books]})

    @classmethod
    def loads(cls, text: str) -> Codes:
        held = json.loads(text)
        return cls(np.array(held["lists"]), [np.array(b) for b in held["books"]], held["probes"])


def units(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction, with the vector scaled to length one (v)."""
    v = F.col("v").cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    most = F.array_max(F.transform(v, F.abs))  # no over- or underflow
    scaled = vectors.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform(v, lambda x: x / most))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("_n", size).withColumn("v", F.transform("v", lambda x: x / F.col("_n"))).drop("_n")


class VectorIndex:
    """An index in a folder: ``lists/list=<number>`` hold (id, code, v and the rows' other columns), ``codes`` the centroids and books."""

    def __init__(self, spark: SparkSession, path: str, codes: Codes):
        self.spark, self.path, self.codes = spark, path, codes

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Of rows (id, v and more, which filters may ask for). ``lists``: about the root of the number of rows, as far as the sample allows."""
        spark, files = vectors.sparkSession, Files(vectors.sparkSession)
        own = units(vectors)
        sample = [r["v"] for r in own.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()]
        dim = len(sample[0]) if sample else 1
        x = np.array([s for s in sample if len(s) == dim]) if sample else np.zeros((0, 1))
        codes = Codes.fit(x, lists or math.isqrt(own.count())) if len(x) else Codes(np.zeros((1, 1)), [np.zeros((1, 1))])

        def encoded(batches):
            for b in batches:
                v = b.column(b.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                own, code = codes.encode(v) if len(v) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(own, pa.int32())], names=[*b.schema.names, "code", "list"])

        rows = own.where(F.size("v") == dim)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        made = rows.mapInArrow(encoded, f"{fields}, code binary, list int")
        made.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        files.write(f"{path}/codes", codes.dumps())  # last, so a folder with it is whole
        return cls(spark, path, codes)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, Codes.loads(Files(spark).read(f"{path}/codes")))

    def rows(self, probed: list[int] | None = None) -> DataFrame:
        """The rows of some lists: other folders aren't read."""
        df = self.spark.read.parquet(f"{self.path}/lists")
        return df if probed is None else df.where(F.col("list").isin(probed))

    def search(self, q: list[float], k: int, probes: int | None = 0, where: Column | None = None) -> DataFrame:
        """(id, dist, dense_rank) of the ``k`` rows nearest to ``q`` by cosine distance among those that meet ``where``, as ``dense`` gives them.

        ``probes``: lists to read; 0: as many as the sample needed; None: all of them, without codes.
        """
        probes = self.codes.probes if probes == 0 else probes
        q = np.array(q, float)
        norm = np.linalg.norm(q)
        if not np.isfinite(norm) or norm == 0 or len(q) != self.codes.dim:
            return self.spark.createDataFrame([], self.rows().select("id", F.lit(0.0).alias("dist"), F.lit(1).cast("long").alias("dense_rank")).schema)
        q = q / norm
        rows = self.rows(None if probes is None else self.codes.probed(q, probes))
        rows = rows if where is None else rows.where(where)
        if probes is not None:
            rows = rows.where(F.col("id").isin([r["id"] for r in self._by_code(rows, q, REFINE * k).collect()]))  # REFINE * k ids
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, q.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        near = rows.select("id", F.round(1 - dot, 9).alias("dist")).orderBy("dist", "id").limit(k)
        return number(near, [F.col("dist"), F.col("id")], "dense_rank")

    def _by_code(self, rows: DataFrame, q: np.ndarray, n: int) -> DataFrame:
        """(id, near) of the ``n`` rows that are nearest by their codes: vectors aren't read."""
        base, tables = self.codes.lists @ q, self.codes.tables(q)

        def scored(batches):
            for b in batches:
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, len(tables))
                near = base[b.column(2).to_numpy()] + sum(t[code[:, k]] for k, t in enumerate(tables))
                best = pa.array(np.argsort(-near, kind="stable")[:n])
                yield pa.RecordBatch.from_arrays([b.column(0).take(best), pa.array(near).take(best)], names=["id", "near"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.select("id", "code", "list").mapInArrow(scored, f"id {kind}, near double").orderBy(F.desc("near"), "id").limit(n)

    def recall(self, questions: list[tuple[object, list[float]]], k: int, probes: int = 0) -> DataFrame:
        """(qid, n, found): of each question's ``k`` exact neighbours how many a search finds."""
        out = []
        for qid, q in questions:  # a stated set
            true = {r["id"] for r in self.search(q, k, None).collect()}
            out.append((qid, len(true), len(true & {r["id"] for r in self.search(q, k, probes).collect()})))
        return self.spark.createDataFrame(out, "qid long, n int, found int")
