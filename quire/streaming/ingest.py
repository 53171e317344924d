"""Continuous ingest: files that appear in a folder are added to a stored library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import last_segment
from ..operators.store import first_wins
from ..plans.schema import BOOKS
from ..sources.ingest import prepared


FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, library: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch's new contents to the Parquet library; a repeated batch adds nothing, as its keys are there."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.select("content", last_segment(F.col("path")).alias("title"), F.unix_micros("modificationTime").alias("ordinal"))
        new = first_wins(prepared(rows)).drop("ordinal")
        stored = batch.sparkSession.read.schema(BOOKS).parquet(library)
        new.join(stored.select("id"), "id", "left_anti").select(BOOKS.fieldNames()).write.mode("append").parquet(library)

    spark.createDataFrame([], BOOKS).write.mode("append").parquet(library)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
