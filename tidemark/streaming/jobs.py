"""Structured Streaming twins of the tape's stateful operators.

A job reads a folder of files as a stream, runs until all that is there is read, and
writes Parquet with a checkpoint in the shared folder; its rows are then read as a
table. The same plans run unbounded with another trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import path


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream, with ts as an instant of UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and return its rows."""
    spark = stream.sparkSession
    out = path(spark, name)
    if mode == "append":
        job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    else:
        job = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, width: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width).start.alias("start"), "event_type").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, key: str, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


Job = Callable[[SparkSession, str], DataFrame]
