"""A landing folder as a stream: each micro-batch goes through the same batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources import files
from quillon.operators import intake, store

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, deliver: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Extract files as they land and hand (documents with pages, batch id) to `deliver`, once per batch id."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        docs = batch.withColumn("mime_type", F.lit(None).cast("string")).withColumn("created_at", F.col("modificationTime"))
        docs = docs.withColumn("id", store.T.stable_id("doc", "path", "modificationTime"))
        deliver(files.extract(docs).drop("content"), batch_id)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def take_in(spark: SparkSession, folder: str, checkpoint: str, matters: Callable[[], DataFrame], actor: str, deliver: Callable[[dict[str, DataFrame], int], None], available_now: bool = True) -> StreamingQuery:
    """Files as they land through the whole intake: `deliver` gets the new rows of documents, pages, alerts and audit_logs.

    Ids depend on path and time alone, so a batch that is delivered again brings the same rows. `matters`
    is asked for at each batch.
    """
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    none = lambda kind: F.lit(None).cast(kind)

    def each(batch: DataFrame, batch_id: int) -> None:
        uploads = batch.select(
            store.T.stable_id("doc", "path", "modificationTime").alias("id"), F.col("path").alias("filename"), "content", none("string").alias("mime_type"), none("string").alias("client_id"), none("string").alias("matter_id"),
            F.lit("Auto").alias("type"), none("string").alias("responsible"), none("date").alias("document_date"), F.col("modificationTime").alias("created_at"),
        )
        deliver(intake.intake(uploads, matters(), actor), batch_id)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def counts_per_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Audit events per action and window, with a watermark that bounds the state (stream or batch)."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")
