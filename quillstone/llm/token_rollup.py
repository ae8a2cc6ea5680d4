"""Token counts kept as additive rollups by source, language and tokenizer version.

A change to the corpus is a batch of signed deltas: an insert adds a document and its tokens, a delete takes them away,
a revised count (a new text or a new tokenizer version) takes the old ones away and adds the new. A batch is summed
up and committed under its id by one rename, so a batch that is sent twice, or again after a lost driver, counts
once. Totals are sums over committed batches; ``compact`` folds these into one snapshot that remembers their ids.
Batches hold a row for each group, not for each document.

Defined results: null sources, languages and versions are groups of their own; a null text has no tokens but is a
document; null signs or counts count as zero. Repeated rows of a batch are changes of their own. Groups that
sum up to no documents and no tokens are left out of the totals. Empty batches may be committed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import delete, fs_of, materialise, new_path, release
from quillstone.llm.tokens import tokenizer

KEY = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, files: list[str], folder: str | None = None, when: dict | None = None) -> DataFrame:
    """``docs`` without text, and n_0, n_1, ... long: tokens of each text under each vocabulary file, in one pass.

    ``when``: by file, a condition; a text that doesn't meet it isn't tokenised with that file and has a null count.
    """
    own = [c for c in docs.columns if c not in ("text", *(f"n_{i}" for i in range(len(files))))]
    wanted = [F.coalesce((when or {}).get(f, F.lit(True)), F.lit(False)).alias(f"_w{i}") for i, f in enumerate(files)]

    def rows(batches):
        for b in batches:
            cols = []
            for i, f in enumerate(files):
                encode = tokenizer(f, folder).encode
                cols.append(pa.array([len(encode(t.as_py() or "")) if w.as_py() else None for t, w in zip(b.column("text"), b.column(f"_w{i}"), strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *cols], names=[*own, *[f"n_{i}" for i in range(len(files))]])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + [f"n_{i} long" for i in range(len(files))])
    return docs.select(*own, "text", *wanted).mapInArrow(rows, schema)


def delta(rows: DataFrame, sign: int, version: str, tokens: str) -> DataFrame:
    """Deltas of documents that come (sign 1) or go (-1) under a tokenizer version."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col(tokens)).alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share. One writer at a time; readers see whole batches only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, p = fs_of(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _snapshot(self) -> str | None:
        names = self._names("snapshots")
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def _ledger(self, at: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{at}/ledger")

    def _folded(self, at: str | None, names: list[str]) -> set[str]:
        """Those of the batches that the snapshot holds; its ledger, which grows with all batches ever committed, stays where it is."""
        return {r["batch"] for r in self._ledger(at).where(F.col("batch").isin(names)).collect()} if at and names else set()

    def _publish(self, made: str, at: str) -> None:
        fs, p = fs_of(self.spark, f"{self.path}/{at}")
        fs.mkdirs(p.getParent())
        if not fs.rename(fs_of(self.spark, made)[1], p):
            raise OSError(f"can't publish {at}")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas (columns of SUMS); false, and no change, if the id has been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"no good batch id: {batch!r}")
        if batch in self._names("batches") or self._folded(self._snapshot(), [batch]):
            return False
        made = f"{self.path}/making-{batch}"
        zero = F.lit(0).cast("long")
        sums = deltas.groupBy(*KEY).agg(F.sum(F.coalesce("docs", zero)).alias("docs"), F.sum(F.coalesce("tokens", zero)).alias("tokens"))
        sums.select(*KEY, "docs", "tokens").write.mode("overwrite").parquet(made)
        self._publish(made, f"batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        at, names = self._snapshot(), self._names("batches")
        folded = self._folded(at, names)
        paths = [f"{self.path}/batches/{b}" for b in names if b not in folded] + ([f"{at}/sums"] if at else [])
        read = self.spark.read.schema(SUMS)
        rows = read.parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self, keep: int = 2) -> None:
        """Folds all batches into a new snapshot and deletes all but the last ``keep``. If this ends half way, totals are as before or as after."""
        names, at = self._names("batches"), self._snapshot()
        folded = self._folded(at, names)
        number = int(at.rsplit("/", 1)[1]) + 1 if at else 0
        made = f"{self.path}/making-snapshot"
        self.totals().write.mode("overwrite").parquet(f"{made}/sums")
        new = self.spark.createDataFrame([(b,) for b in names if b not in folded], "batch string")
        (self._ledger(at).union(new) if at else new).write.mode("overwrite").parquet(f"{made}/ledger")
        self._publish(made, f"snapshots/{number:012d}")
        for b in names:
            delete(self.spark, f"{self.path}/batches/{b}")
        for old in self._names("snapshots")[:-keep]:
            delete(self.spark, f"{self.path}/snapshots/{old}")


#: The production query's versions: all documents are counted with the first, then those not in English move to the second.
VERSIONS = ["word_bpe_49k.json", "piece_bpe_32k.model"]


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, revises the counts of those not in English, deletes those labelled toxic, replays the load."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    moved = ~F.col("lang").eqNullSafe("en")
    counts = materialise(count_tokens(docs, VERSIONS, when={VERSIONS[1]: moved}), "token-counts")
    old, new = (v.rsplit(".", 1)[0] for v in VERSIONS)
    rollup = Rollup(spark, new_path(spark, "rollup"))
    load = delta(counts, 1, old, "n_0")
    rollup.commit("load", load)
    revised = counts.where(moved)
    rollup.commit("revise", delta(revised, -1, old, "n_0").union(delta(revised, 1, new, "n_1")))
    gone = counts.join(toxic, "doc_id", "left_semi")
    rollup.commit("delete", delta(gone.where(~moved), -1, old, "n_0").union(delta(gone.where(moved), -1, new, "n_1")))
    rollup.compact()
    rollup.commit("load", load)
    release(counts)
    return rollup.totals().select(*KEY, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))
