"""Normalised compression distances of candidate pairs of strings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.code import ship
from tidemark.sources.scratch import written

ORDER = ["d", "slot", "txi"]
#: Symbols of a stretch, the most items that a stretch may stand in to make candidates, and the stretches that a pair must share.
STRETCH, RARE, SHARED = 3, 8, 2
LEVEL = 9
#: An item's string is that of its first trades: the codec looks back no further than about as many.
FIRST = 10_000


def candidate_pairs(items: DataFrame) -> DataFrame:
    """a < b: pairs of items that share SHARED or more stretches of symbols which stand in at most RARE items each.

    A stretch in more items tells nothing apart and makes no pairs, so no key makes more
    than RARE squared of them.
    """
    w = Window.partitionBy("item").orderBy(*ORDER)
    grams = items.select("item", F.concat(*(F.lead("symbol", k).over(w) if k else F.col("symbol") for k in range(STRETCH))).alias("gram")).where("gram IS NOT NULL").distinct()
    rare = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n").between(2, RARE)).select("gram")
    known = written(grams.join(rare, "gram"), "grams")
    pairs = known.select("gram", F.col("item").alias("a")).join(known.select("gram", F.col("item").alias("b")), "gram").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= SHARED)


def compressed(x: bytes) -> int:
    return len(zlib.compress(x, LEVEL))


def compression_distances(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared, size_a, size_b, size_ab, distance: (size_ab - least) / largest of the two sizes. Each item is compressed once, each pair once, in tasks over the pairs."""
    ship(items.sparkSession)
    kept = items.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(*ORDER))).where(F.col("k") <= FIRST)
    strings = kept.groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "symbol"))), lambda x: x["symbol"]), "").alias("text"))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(size=[compressed(t.encode()) for t in x["text"]])

    known = written(strings.mapInPandas(sizes, "item long, text string, size long"), "ncd-items")
    side = lambda c: known.select(F.col("item").alias(c), F.col("text").alias(f"text_{c}"), F.col("size").alias(f"size_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            size = [compressed((a + b).encode()) for a, b in zip(x["text_a"], x["text_b"], strict=True)]
            x = x.assign(size_ab=size).drop(columns=["text_a", "text_b"])
            low, high = x[["size_a", "size_b"]].min(axis=1), x[["size_a", "size_b"]].max(axis=1)
            yield x.assign(distance=(x["size_ab"] - low) / high)[["a", "b", "shared", "size_a", "size_b", "size_ab", "distance"]]

    return both.mapInPandas(distances, "a long, b long, shared long, size_a long, size_b long, size_ab long, distance double")
