"""Interval algebra on (key, start, end) tables of half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_union(df: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching intervals of a key, merged. Empty intervals are left out."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.where("start < end").withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def interval_subtract(base: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """What of base is in no hole: one sweep over both sides' ends, keeping stretches with base open and no hole."""
    edge = lambda df, b, h: df.where("start < end").select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(b).alias("b"), F.lit(h).alias("h")), F.struct(F.col("end").alias("at"), F.lit(-b).alias("b"), F.lit(-h).alias("h")))).alias("e")).select(key, "e.*")
    edges = edge(base, 1, 0).unionByName(edge(holes, 0, 1)).groupBy(key, "at").agg(F.sum("b").alias("b"), F.sum("h").alias("h"))
    w = Window.partitionBy(key).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = edges.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("b").over(run).alias("b"), F.sum("h").over(run).alias("h"))
    return interval_union(swept.where("b > 0 AND h = 0").select(key, "start", "end"), key)
