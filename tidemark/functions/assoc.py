"""Associative arrays as (row, col, val) tables: keys are unique and zeros are not stored."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.code import ship
from tidemark.sources.scratch import written

SEMIRINGS = {
    "plus_times": (lambda a, b: a * b, F.sum),
    "max_plus": (lambda a, b: a + b, F.max),
    "min_plus": (lambda a, b: a + b, F.min),
    "max_min": (F.least, F.max),
    "or_and": (lambda a, b: F.lit(1.0), F.max),
}
#: Entries of an inner key that stay together.
PART = 2_000
#: Pairs that are counted together, about.
PAIRS = 5_000_000
AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def from_tuples(df: DataFrame, aggregate: str = "sum", order: str | None = None) -> DataFrame:
    """One entry per (row, col); `first` takes the value of the least `order`. Zeros are dropped."""
    value = F.min_by("val", order) if aggregate == "first" else AGGREGATES[aggregate]("val")
    return df.groupBy("row", "col").agg(value.alias("val")).where("val != 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def matmul(a: DataFrame, b: DataFrame, semiring: str = "plus_times") -> DataFrame:
    """The product over a semiring: a join on the inner key, then the semiring's sum; zeros are dropped.

    Partial aggregation runs before the second shuffle. An inner key with many entries
    is met in parts (see met).
    """
    times, plus = SEMIRINGS[semiring]
    pairs = met(a.select("row", F.col("col").alias("_k"), F.col("val").alias("_a")), b.select(F.col("row").alias("_k"), "col", F.col("val").alias("_b")), "row", "col")
    return pairs.groupBy("row", "col").agg(plus(times(F.col("_a"), F.col("_b"))).alias("val")).where("val != 0")


def met(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a and b joined on _k. Where a key has over PART entries on a side, each side's are cut into parts by a hash of its other key, and every part of one meets every part of the other in a task of its own: none makes more than about PART squared rows of a key."""
    count = lambda df, n: df.groupBy("_k").agg(F.ceil(F.count("*") / PART).cast("int").alias(n))
    cuts = count(a, "_i").join(count(b, "_j"), "_k").where("_i > 1 OR _j > 1")
    cut = lambda df: df.join(cuts, "_k", "left").fillna(1, ["_i", "_j"])
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cut(a).select("*", every("_j").alias("_y")).withColumn("_x", part(a_key, "_i")).drop("_i", "_j")
    right = cut(b).select("*", every("_i").alias("_x")).withColumn("_y", part(b_key, "_j")).drop("_i", "_j")
    return left.join(right, ["_k", "_x", "_y"]).drop("_x", "_y")


def degree(a: DataFrame, axis: str = "row") -> DataFrame:
    return a.groupBy(F.col(axis).alias("key")).agg(F.count("*").alias("degree"))


def select(a: DataFrame, row=None, col=None, keep: Column | None = None) -> DataFrame:
    """Entries whose row and column are chosen, each by a list, a range, a compiled pattern that its whole text must match, or a function of the column; keep: a condition on the entry."""

    def chosen(key: str, by) -> Column:
        c = F.col(key)
        if isinstance(by, range):
            inside = c.between(by.start, by.stop - 1)
            return inside if by.step == 1 else inside & ((c - by.start) % by.step == 0)
        if isinstance(by, re.Pattern):
            return c.cast("string").rlike(f"^(?:{by.pattern})$")
        return by(c) if callable(by) else c.isin(list(by))

    for key, by in (("row", row), ("col", col)):
        if by is not None:
            a = a.where(chosen(key, by))
    return a if keep is None else a.where(keep)


def restrict_degree(a: DataFrame, axis: str, most: int) -> DataFrame:
    """Entries of keys with at most `most` entries on the axis."""
    return a.join(degree(a, axis).where(F.col("degree") <= most).select(F.col("key").alias(axis)), axis, "left_semi").select("row", "col", "val")


def co_occurrence(a: DataFrame, least: int = 1, kept: bool = False) -> DataFrame:
    """Pairs of rows (row < col) with the number of columns they share, from `least` up; kept: a's entries are unique and read from files.

    A column travels as the list of its rows, once for each range of rows that it touches;
    pairs are made and counted where the range's lists are, and are not shuffled. Ranges
    hold as many entries as one another, and are as many as the pairs ask for. A column
    with over PART rows is cut into lists of about PART that meet each other.
    """
    spark = a.sparkSession
    ship(spark)
    b = a.select("row", "col").where("row IS NOT NULL AND col IS NOT NULL")
    b = b if kept else written(b.distinct(), "entries")
    sizes = b.groupBy("col").agg(F.count("*").alias("_n"))
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)).first()[0] or 0
    ranges = int(max(most, pairs // PAIRS))
    numeric = b.schema["row"].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    edges = b.agg(F.percentile_approx("row", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if numeric else None

    cuts = sizes.where(F.col("_n") > PART).select("col", F.ceil(F.col("_n") / PART).cast("int").alias("_n"))
    part = F.pmod(F.xxhash64("row"), F.coalesce("_n", F.lit(1))).cast("int").alias("_part")
    lists = b.join(cuts, "col", "left").select("row", "col", "_n", part).groupBy("col", "_n", "_part").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = lists.where("_n IS NULL").select("rows")
    large = lists.where("_n IS NOT NULL")
    met_ = large.select("col", "rows").join(large.select("col", F.col("rows").alias("cols")), "col").select("rows", "cols")
    if numeric:
        schema = T.StructType([T.StructField("range", T.IntegerType()), met_.schema["rows"], met_.schema["cols"]])
        cut = _dealt(np.unique(np.array(edges or [])))
        dealt = whole.mapInArrow(cut, schema).unionByName(met_.mapInArrow(cut, schema))
    else:
        both = whole.select("rows", F.col("rows").alias("cols")).unionByName(met_).select(F.explode("rows").alias("_r"), "cols")
        dealt = both.select(F.pmod(F.xxhash64("_r"), F.lit(ranges)).cast("int").alias("range"), F.array("_r").alias("rows"), "cols")
    near = dealt.repartition(ranges, "range")
    each = near.select("range", F.explode("rows").alias("row"), "cols").select("range", "row", F.explode("cols").alias("col")).where("row < col")
    return each.groupBy("range", "row", "col").agg(F.count("*").cast("double").alias("val")).where(F.col("val") >= least).drop("range")


def _dealt(edges: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of sorted rows cut where a range ends, each with the list that it meets; that is its own list, from its first row on, where none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            if not len(rows):
                continue
            flat, sizes = rows.flatten(), rows.value_lengths().to_numpy()
            line = np.repeat(np.arange(len(rows)), sizes)
            at = np.searchsorted(edges, flat.to_numpy()).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (line[1:] != line[:-1])]))
            cut = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), flat)
            if batch.num_columns > 1:
                cols = batch.column(1).take(pa.array(line[first]))
            else:
                n = np.cumsum(sizes)[line[first]] - first
                upto = np.cumsum(n)
                cols = pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), flat.take(pa.array(np.arange(upto[-1]) + np.repeat(first - (upto - n), n))))
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), cut, cols], ["range", "rows", "cols"])

    return run


def similarity(overlap: DataFrame, degrees: DataFrame, kind: str = "jaccard") -> DataFrame:
    """overlap's values as jaccard, overlap coefficient or cosine of the two rows' column sets."""
    x = overlap.join(degrees.select(F.col("key").alias("row"), F.col("degree").alias("_x")), "row").join(degrees.select(F.col("key").alias("col"), F.col("degree").alias("_y")), "col")
    by = {"jaccard": F.col("_x") + F.col("_y") - F.col("val"), "overlap": F.least("_x", "_y"), "cosine": F.sqrt(F.col("_x").cast("double") * F.col("_y"))}[kind]
    return x.select("row", "col", (F.col("val") / by).alias("val"))
