"""Bars: open, high, low, close and volume per series and day, never filled forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.sources.tables import table


@query(
    "minute_bars",
    """
SELECT l_partkey AS mint, CAST(l_shipdate AS DATE) AS day, count(*) AS n_trades,
       count(*) FILTER (l_returnflag <> 'R') AS n_buys, count(*) FILTER (l_returnflag = 'R') AS n_sells,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS DOUBLE) AS signed_flow,
       arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS close
FROM lineitem WHERE l_quantity > 0 GROUP BY ALL
""",
)
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    quantity = F.col("l_quantity").cast("decimal(18,2)")
    sold = F.col("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_quantity > 0")
        .groupBy(F.col("l_partkey").alias("mint"), F.to_date("l_shipdate").alias("day"))
        .agg(
            F.count("*").alias("n_trades"),
            F.count_if(~sold).alias("n_buys"),
            F.count_if(sold).alias("n_sells"),
            F.sum(quantity).cast("double").alias("volume"),
            F.sum(quantity * F.when(sold, -1).otherwise(1)).cast("double").alias("signed_flow"),
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
        )
    )
