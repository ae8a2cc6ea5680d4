"""Streams into a library: files of rows as they arrive, and counts over the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.library import ROWS, Library


def ingest_files(library: Library, folder: str, checkpoint: str, files_per_batch: int = 100, force: bool = True) -> StreamingQuery:
    """Ingests Parquet files of rows that come into the folder. A batch that runs again replaces the same papers, so it counts once."""
    stream = library.spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        try:
            library.ingest(held, force=force)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searches_by_hour(spark: SparkSession, folder: str, schema: str, late: str = "1 hour") -> DataFrame:
    """Searches by label and hour from the log's folder (retrieved_at as ISO text); later ones than ``late`` are left out."""
    log = spark.readStream.schema(schema).parquet(folder).withColumn("at", F.to_timestamp("retrieved_at"))
    hours = log.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "label")
    return hours.agg(F.count("*").alias("n"), F.sum("total_count").alias("hits"))
