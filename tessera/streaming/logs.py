"""The same transforms over Structured Streaming: new logs as they arrive.

Files are taken once each (``availableNow``), with progress in a checkpoint, so a
run resumes where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.logs import tool_events


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """log_id, body of files that appear below a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("log_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def take_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``each`` on every batch of what is there now, then stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_of_new_logs(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Tool events of new logs, appended to a table partitioned by dialect; a batch that is tried again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        rows = tool_events(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "dialect").parquet(out)

    return take_available(log_stream(spark, path), checkpoint, each)
