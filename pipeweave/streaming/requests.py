"""Streams of requests and of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.sources.geojson import decode, validate
from pipeweave.storage import Scratch


def once_per_hour(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal requests (user_id, event_type) of each hour; state goes when the watermark passes."""
    hour = requests.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hour", F.date_trunc("hour", "ts"))
    return hour.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"])


def counts_by_window(requests: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Requests and their mean value by type in tumbling windows."""
    at = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def validated_files(spark: SparkSession, folder: str, files_at_once: int = 2) -> DataFrame:
    """Features of newline-delimited files as they come in, with error_path; a few files a batch."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(folder)
    return validate(decode(lines.select(F.xxhash64("value").alias("ordinal"), F.col("value").alias("line"))))


def drained(stream: DataFrame, table: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, into a memory table, and returns that; for tests and small results."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return spark.table(table)


def landed(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet files in the shared folder, and returns those. Rows do not pass the driver."""
    folder = f"{Scratch(stream.sparkSession, name).root}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
