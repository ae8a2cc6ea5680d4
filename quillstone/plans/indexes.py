"""Stored indexes of the tables that questions are asked of: made once for the tables as they are, then read."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import bitmaps as B
from quillstone.operators import positions as P
from quillstone.operators import retrieval as R
from quillstone.sources import tables as T
from quillstone.sources.versions import Files, workspace

#: The fields that bitmaps of the chunk store have: its own, and the projects that a row's paper is a member of.
FIELDS = ["type", "section", "tags", "page", "project"]

NEEDS = {"documents": ["documents"], "rows": ["documents", "labels"]}


def indexed(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name == "documents":
        return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text", "lang", "source", "n_chars")
    none = F.lit(None).cast("array<string>").alias("source_chunk_ids")
    return T.chunks(spark, d).select(*T.COLUMNS, none).unionByName(T.claims(spark, d).select(*T.COLUMNS, "source_chunk_ids"))


def index_of(spark: SparkSession, d: str, name: str) -> R.Index:
    """The index of a table; other files at the path make another index."""
    files = Files(spark)
    stamp = json.dumps([d, *(files.stamp(f"{d}/{t}.parquet") for t in NEEDS[name])])
    path = f"{workspace(spark)}/index-{name}-{hashlib.md5(stamp.encode()).hexdigest()}"
    if not files.exists(f"{path}/numbers/_SUCCESS"):
        return R.write_index(indexed(spark, d, name), path, kind=R.kind_of(F.col("type")) if name == "rows" else None)
    return R.read_index(spark, path)


def positions_of(spark: SparkSession, d: str) -> P.Positions:
    """Positional postings of documents, likewise."""
    files = Files(spark)
    stamp = json.dumps([d, files.stamp(f"{d}/documents.parquet")])
    path = f"{workspace(spark)}/positions-{hashlib.md5(stamp.encode()).hexdigest()}"
    if not files.exists(f"{path}/terms/_SUCCESS"):
        return P.write_positions(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text"), path)
    return P.read_positions(spark, path)


def bitmaps_of(spark: SparkSession, d: str) -> DataFrame:
    """Bitmaps of the chunk store's rows by their seq, likewise."""
    files = Files(spark)
    stamp = json.dumps([d, FIELDS, *(files.stamp(f"{d}/{t}.parquet") for t in NEEDS["rows"])])
    path = f"{workspace(spark)}/bitmaps-{hashlib.md5(stamp.encode()).hexdigest()}"
    if not files.exists(f"{path}/_SUCCESS"):
        projects = T.members(spark, d).groupBy("doc_key").agg(F.collect_set("project").alias("project"))  # a paper's few projects
        return B.write_bitmaps(B.entries(T.rows(spark, d).select("doc_key", "seq", "type", "section", "tags", "page").join(projects, "doc_key", "left"), "seq", FIELDS), path)
    return B.read_bitmaps(spark, path)
