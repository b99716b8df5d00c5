"""Joins that Spark has no operator for, as compositions of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], forward: bool = False) -> DataFrame:
    """Every left row with `columns` and the time (as right_<time>) of the last right row of its key at or before its time, or the first at or after it.

    One shuffle on the key: both sides are unioned and the last right row is carried
    along the key's time order. Of right rows of one key and time the greatest counts.
    Left rows without a match keep nulls.
    """
    matched = F.struct(F.col(time).alias("_t"), *columns)
    r = right.groupBy(key, time).agg(F.max(F.struct(*columns)).alias("_c")).select(key, time, *(F.col(f"_c.{c}").alias(c) for c in columns))
    both = left.select(key, time, F.struct(*left.columns).alias("_left"), F.lit(None).cast(r.select(matched.alias("m")).schema["m"].dataType).alias("_m"), F.lit(1).alias("_side")).unionByName(r.select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), matched.alias("_m"), F.lit(0).alias("_side")))
    order = [F.desc(time), F.asc("_side")] if forward else [F.asc(time), F.asc("_side")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return out.select("_left.*", F.col("_m._t").alias(f"right_{time}"), *(F.col(f"_m.{c}").alias(c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, key: str, time: str, width: int, columns: list[str], before: bool = True) -> DataFrame:
    """Pairs of a left row and the right rows of its key in [time - width, time) (before) or (time, time + width].

    An equi-join on (key, time bucket of `width`): each left row meets two buckets, so no
    pair of rows further apart than two widths is ever formed. The right time is right_<time>.
    """
    bucket = F.floor(F.col(time) / width)
    other = bucket - 1 if before else bucket + 1
    l = left.withColumn("_b", F.explode(F.array(bucket, other)))
    r = right.select(F.col(key).alias("_k"), F.col(time).alias(f"right_{time}"), bucket.alias("_rb"), *columns)
    gap = F.col(time) - F.col(f"right_{time}")
    inside = (gap > 0) & (gap <= width) if before else (gap < 0) & (gap >= -width)
    return l.join(r, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb"))).where(inside).drop("_b", "_k", "_rb")
