"""Tables as numbered versions in a folder: a write makes the next version, readers take the newest complete one.

So a table that is being read is never overwritten, and a write that is cut short changes nothing.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The folder for tables that the application makes for itself: in ``spark.checkpoint.dir``, or where that is unset, on one machine, a temporary one."""
    base, app = spark.conf.get("spark.checkpoint.dir", "") or "", spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = "file://" + _own[app]
    return f"{base.rstrip('/')}/{app}-library"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the workspace: what several readers need is made once, and lineage ends there."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and folders of any store that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def stamp(self, path: str) -> list[tuple[str, int, int]]:
        """Name, length and time of the files of a path: another content gives another stamp."""
        fs, p = self._fs(path)
        return sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p))

    def read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed."""
        fs, made = self._fs(f"{path}.{uuid.uuid4().hex[:8]}.part")
        stream = fs.create(made, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        at = self._fs(path)[1]
        fs.delete(at, False)
        if not fs.rename(made, at):
            raise OSError(f"can't write {path}")

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{self.root}/{table}/{s.getPath().getName()}/_SUCCESS")[1])]
        return sorted(int(n) for n in done if n.isdigit())

    def exists(self, table: str) -> bool:
        return bool(self.numbers(table))

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The newest version; without any, an empty table of the schema."""
        if not (found := self.numbers(table)):
            if schema is None:
                raise FileNotFoundError(f"no table {table} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{table}/{found[-1]:09d}")

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        at = f"{self.root}/{table}/{max(self.numbers(table), default=0) + 1:09d}"
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(at)
        return self.spark.read.parquet(at)

    def vacuum(self, table: str, keep: int = 2) -> None:
        for n in self.numbers(table)[:-keep]:
            fs, p = self._fs(f"{self.root}/{table}/{n:09d}")
            fs.delete(p, True)


class Parts:
    """Tables dealt to hash parts by a key: a change writes the parts that it touches, and a manifest says which folders make the tables now.

    A part of a table is ``data/<change>/<table>/_part=<number>``. Manifests are numbered and never written again; the newest counts. A change
    writes folders of its own and then one manifest, so one that is cut short changes nothing, and what was read before stays
    readable until ``vacuum`` is called. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = 32):
        self.spark, self.root, self.key, self.files = spark, root.rstrip("/"), key, Files(spark)
        self.parts = self.manifest().get("parts_number", parts)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        found = self.numbers()
        return json.loads(self.files.read(f"{self.root}/manifests/{number or found[-1]:09d}.json")) if found else {}

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def parts_with(self, keys: DataFrame) -> list[int]:
        """The parts that rows with these keys are in: no more numbers than parts."""
        return sorted(r[0] for r in keys.select(self.part_of(F.col(self.key))).distinct().collect())

    def read(self, table: str, schema: str, only: list[int] | None = None, tables: dict | None = None) -> DataFrame:
        """The table, or the parts of it asked for; of the newest manifest if it isn't said which ``tables`` (see ``staged``)."""
        held = (self.manifest().get("tables", {}) if tables is None else tables).get(table, {})
        paths = [f"{self.root}/data/{change}/{table}/_part={p}" for p, change in held.items() if only is None or int(p) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def put(self, table: str, df: DataFrame, change: str, *sort: str) -> set[int]:
        """Writes rows into folders of the change, a part's rows in order of ``sort``; the parts that have any. Rows with a ``_part`` go there. Nothing reads them before ``publish``."""
        at = f"{self.root}/data/{change}/{table}"
        dealt = df if "_part" in df.columns else df.withColumn("_part", self.part_of(F.col(self.key)))
        dealt = dealt.repartition(min(self.parts, 200), "_part").sortWithinPartitions("_part", *sort)
        dealt.write.mode("overwrite").partitionBy("_part").parquet(at)
        return {int(n[6:]) for n in self.files.names(at) if n.startswith("_part=")}

    def staged(self, change: str, written: dict[str, tuple[list[int], set[int]]]) -> dict:
        """The folders of all tables as they are with the change: of each table the touched parts are those written, or none."""
        tables = {t: dict(x) for t, x in self.manifest().get("tables", {}).items()}
        for table, (touched, have) in written.items():
            held = tables.setdefault(table, {})
            for p in touched:
                held.pop(str(p), None)
            held.update({str(p): change for p in have})
        return tables

    def publish(self, tables: dict, more: dict) -> None:
        """The tables are now these. ``more``: other entries of the manifest."""
        number = max(self.numbers(), default=0) + 1
        self.files.write(f"{self.root}/manifests/{number:09d}.json", json.dumps({**self.manifest(), **more, "tables": tables, "parts_number": self.parts}))

    def vacuum(self, older_than: float) -> int:
        """Deletes manifests that were replaced more than so many seconds ago, and older folders that no manifest left names; how many folders went.

        Frames made before then lose their files; choose a time that no reader and no change takes.
        """
        numbers, before = self.numbers(), time.time() - older_than
        made = {name: t / 1000 for name, _, t in self.files.stamp(f"{self.root}/manifests")} if numbers else {}
        gone = [n for n, after in zip(numbers, numbers[1:], strict=False) if made[f"{after:09d}.json"] < before]
        named = {c for n in numbers if n not in gone for x in self.manifest(n)["tables"].values() for c in x.values()}
        for n in gone:
            self.files.delete(f"{self.root}/manifests/{n:09d}.json")
        dead = [name for name, _, t in (self.files.stamp(f"{self.root}/data") if numbers else []) if name not in named and t / 1000 < before]
        for c in dead:
            self.files.delete(f"{self.root}/data/{c}")
        return len(dead)
