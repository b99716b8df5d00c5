"""Scans and sinks: columnar files, JSON lines and CSV, with schemas given and bad lines kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import path


def sorted_sink(df: DataFrame, at: str, keys: list[str], partition: str | None = None) -> None:
    """zstd Parquet, range-partitioned and sorted by keys, so that row groups can be skipped; `partition` makes hive folders."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*([partition] if partition else []), *keys).write.option("compression", "zstd")
    (out.partitionBy(partition) if partition else out).parquet(at)


def json_lines(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a line that does not parse is kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(at)


def through(df: DataFrame, kind: str, name: str, **options: str) -> str:
    """Write df as `kind` to the shared folder; returns the path."""
    at = path(df.sparkSession, name)
    df.write.format(kind).options(**options).save(at)
    return at


def torn_lines(df: DataFrame, name: str) -> str:
    """The events as JSON lines with every hundredth one torn in the middle, as a crashed writer leaves them."""
    line = F.to_json(F.struct("event_id", "user_id", "kind"))
    return through(df.select(F.when(F.col("event_id") % 100 == 7, F.substring(line, 1, 14)).otherwise(line).alias("value")), "text", name)
