"""Ranks and running totals over a whole table, without a window that one task would hold.

Rows are dealt by range of the order and written; a range's total is known from one
aggregate, so each task only adds what stands before its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def running(df: DataFrame, order: list[Column | str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """df with the sum (or min) of value over all rows up to each one in the order, as `name`. The order must be total, or ties stand in any order."""
    keys = [F.expr(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumn("_v", value).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    add = F.sum if how == "sum" else F.min
    # As many rows as there are ranges.
    each = dealt.groupBy("_part").agg(add("_v").alias("_all"))
    before = each.select("_part", add("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = add("_v").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in") if how == "sum" else F.least("_before", "_in")
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(name, total).drop("_v", "_part", "_before", "_in")


def numbered(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """df with each row's number from 1 in the order."""
    return running(df, order, F.lit(1), name)


def ranks(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with n (its rows), first (the rank of them all) and mid (their middle rank); one row for each value, not for each row."""
    counts = running(df.groupBy(value).agg(F.count("*").alias("n")), [value], F.col("n"), "_upto")
    return counts.select(value, "n", (F.col("_upto") - F.col("n") + 1).alias("first"), (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("mid"))


def tiles(df: DataFrame, order: list[Column | str], k: int, name: str) -> DataFrame:
    """df with the number from 1 to k of the tile of equal sizes (the first ones larger by one) that each row is in."""
    n = df.count()
    size, more = divmod(n, k)
    at = F.col("_rn") - 1
    edge = more * (size + 1)
    tile = F.when(at < edge, F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - edge) / max(size, 1)) + 1)
    return numbered(df, order, "_rn").withColumn(name, tile.cast("long")).drop("_rn")


def quantiles(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of value by group, halfway values interpolated, as columns named by `at`; nulls take no part. A group of any size is spread over ranges of its values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    placed = written(running(counts, [group, value], F.col("n"), "_upto"), "quantiles")
    sizes = placed.groupBy(group).agg(F.min(F.col("_upto") - F.col("n")).alias("_base"), F.sum("n").alias("_n"))
    rows = placed.join(sizes, group)
    first, last = F.col("_upto") - F.col("n") - F.col("_base"), F.col("_upto") - F.col("_base") - 1
    picked = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("_n") - 1)
        for i, k in enumerate((F.floor(place), F.ceil(place))):
            picked.append(F.max(F.when((first <= k) & (k <= last), F.col(value))).alias(f"{name}_{i}"))
    out = rows.groupBy(group).agg(F.first("_n").alias("_n"), *picked)
    part = {name: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1)) for name, p in at.items()}
    return out.select(group, *((F.col(f"{n}_0") + (F.col(f"{n}_1") - F.col(f"{n}_0")) * part[n]).alias(n) for n in at))
