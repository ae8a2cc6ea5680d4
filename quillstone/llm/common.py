"""What the operators share: the cluster's shared folder, ranks in skewed groups, components of a link graph."""

from __future__ import annotations

import atexit
import math
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Tables written inside ``scratch`` blocks, innermost last.
_scratch: list[list[str]] = []

#: Rows that a task writes of a table whose number of rows is known.
FILE_ROWS = 100_000
#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Matrices of sets are made for so many elements at a time.
_COLUMNS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = "file://" + _own[app]
    return f"{base.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system for the path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cuts lineage by a table in the shared folder; a lost executor costs no more than what it was reading.

    ``rows``: a bound on its rows where one is known; few rows are then written by few tasks, FILE_ROWS each.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the tables that ``materialise`` wrote, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that ``materialise`` wrote inside, but those given to the function that it yields."""
    made: list[str] = []
    _scratch.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df._stored_at)
        return df

    try:
        yield keep
    finally:
        _scratch.remove(made)
        for path in made:
            delete(spark, path)


def sweep(spark: SparkSession) -> None:
    """Deletes the application's whole folder: call it when no result is read any more, at the latest at the application's end."""
    delete(spark, shared_dir(spark))


def kept(name, make):
    """What ``make`` gives, made once in a process: for tables that workers need again and again, outside what travels with a function."""
    held = sys.modules.setdefault("_quillstone_kept", types.ModuleType("_quillstone_kept")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def ranked(df: DataFrame, group: list[str], order: list[str], total: int, name: str = "rank", bucket_rows: int = 400, most_buckets: int = 20_000) -> DataFrame:
    """Adds the 0-based rank of each row in its group, a group being as large as it likes.

    Rows are dealt to hash buckets inside their group; a window ranks them within (group, bucket) and the
    buckets' row counts, summed up per group, give where each bucket starts. So no task holds a whole group,
    and a group has at most ``most_buckets`` counts. The order is by bucket, then by ``order``: arbitrary, but
    the same each time; rows equal in all of ``order`` may change places with each other.
    """
    n = min(most_buckets, max(1, math.ceil(total / bucket_rows)))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    # one key for window and join, in which nulls are equal, so that the rows are shuffled once
    df = df.withColumn("_key", F.struct(*group, "_bucket"))
    starts = df.groupBy("_key").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*[F.col(f"_key.{g}") for g in group]).orderBy("_key._bucket")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    out = df.withColumn(name, place).join(starts, "_key")
    return out.withColumn(name, F.col("_start") + F.col(name) - 1).drop("_start", "_bucket", "_key")


def forest(linked: np.ndarray) -> np.ndarray:
    """For a matrix of links between n rows and m columns: the least node of each node's component, rows being nodes 0.., columns n.. .

    So n + m numbers say what up to n * m links connect.
    """
    n, none = len(linked), sum(linked.shape)
    least = np.arange(none)
    while True:
        rows = np.minimum(least[:n], np.where(linked, least[None, n:], none).min(1, initial=none))
        columns = np.minimum(least[n:], np.where(linked, rows[:, None], none).min(0, initial=none))
        now = np.concatenate([rows, columns])
        if (now == least).all():
            return least
        least = now


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each sorted set of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.float32)
    sizes = [np.array([len(s) for s in sets], int) for sets in (x, y)]
    flat = [np.concatenate(sets) if sets else np.zeros(0, np.int64) for sets in (x, y)]
    both = np.intersect1d(*map(np.unique, flat))
    placed = []
    for values, size in zip(flat, sizes, strict=True):
        at = np.searchsorted(both, values)
        held = np.nonzero(both[np.minimum(at, len(both) - 1)] == values)[0] if len(both) else np.zeros(0, int)
        placed.append((np.repeat(np.arange(len(size)), size)[held], at[held]))
    for start in range(0, len(both), _COLUMNS):
        wide = min(_COLUMNS, len(both) - start)
        made = []
        for (row, column), size in zip(placed, sizes, strict=True):
            own = (column >= start) & (column < start + wide)
            m = np.zeros((len(size), wide), np.float32)
            m[row[own], column[own] - start] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each linked node: (node, component), for nodes that have links.

    Alternates the large-star and small-star steps of the two-phase algorithm of Kiveris et al. (2014) until the
    edges stand still. A node's neighbourhood is never gathered: its least neighbour comes from an aggregate and
    goes back by a join, which Spark may split where a node is hot. Each round is a table in the shared folder.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = materialise(edges.where(f"{a} <> {b}").select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", mark[0])
        release(e)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
