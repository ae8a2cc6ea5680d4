"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents; other columns are left out.

A null text counts as empty, so the quality rules reject it. Rows with a null doc_id, and rows that share a doc_id, are documents of
their own in all stages: a row goes only for what its own text is. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing, packing, pii, quality, simhash
from quillstone.llm.common import materialise, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the length of what is now the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject and takes boilerplate lines out of the others; a null source is a host of its own."""
    return counted(quality.clean(docs, **quality.CLEANING))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8): that with the smallest doc_id, null ids last.

    Rows that share that doc_id but not the group are kept; of equal texts with equal ids one row is kept.
    """
    return simhash.deduplicate(docs).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts replaced by their kind; all rows stay."""
    return counted(pii.redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the schedule, those of sources too small for their weight again in later epochs.

    A document that comes again is a row like any other. Files follow the schedule, and so do rows within a file.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), order=["doc_id", "text"])
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, which follow the schedule: the order of its files' numbers, and of rows within a file.

    What doesn't come from files has no order, and is packed as a whole.
    """
    try:
        rows = docs.select("doc_id", "text", F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d{1,9})", 1).try_cast("long"), F.lit(0)).alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # rows made on the way have no files
        return packing.pack(docs)
    return packing.pack_in_order(rows.withColumn("window", F.expr(f"file * 4294967296 + place div {packing.WINDOW_ROWS}")), "window", "place")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("pii", pii_redaction),
    ("mixing", source_mixing),
    ("packing", packed_sequences),
]

#: SQL can't express near copies by shingles, the span classifier or token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables go when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            after = keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        release(docs)
        docs = after
    return docs
