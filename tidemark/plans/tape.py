"""The market tape over the driver's tables: one view per relation, the same in Spark and in the oracle.

trades   one fill: mint, owner, slot, txi, day, d (day number), t (seconds), side, qty, delta (signed), cents, px
ev       one event: event_id, user_id, kind, t (seconds), value, props
calls    one callout: call_id, caller, mint, t, price
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_TRADES = """SELECT l_partkey AS mint, l_suppkey AS owner, l_orderkey AS slot, l_linenumber AS txi, CAST(l_shipdate AS DATE) AS day,
 {day_number} AS d, {day_number} * 86400 + l_orderkey % 86400 AS t, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side,
 CAST(floor(l_quantity + 0.5) AS BIGINT) AS qty, CAST(floor(l_quantity + 0.5) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS delta,
 CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, l_extendedprice / l_quantity AS px, l_linestatus AS status, l_discount AS discount, l_tax AS tax
 FROM lineitem WHERE l_quantity > 0"""
_EV = "SELECT event_id, user_id, event_type AS kind, {seconds} AS t, value, props FROM events"
_CALLS = "SELECT o_orderkey AS call_id, CAST(floor(o_orderkey / 40) AS BIGINT) AS caller, o_custkey AS mint, {order_day} * 86400 + 43200 AS t, o_totalprice AS price FROM orders"

SPARK = {
    "trades": _TRADES.format(day_number="CAST(datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01') AS BIGINT)"),
    "ev": _EV.format(seconds="timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"),
    "calls": _CALLS.format(order_day="CAST(datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01') AS BIGINT)"),
}
DUCKDB = {
    "trades": _TRADES.format(day_number="CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS BIGINT)"),
    "ev": _EV.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)"),
    "calls": _CALLS.format(order_day="CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT)"),
}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables and relations that text names."""
    words = set(re.findall(r"\w+", text))
    for name, sql in SPARK.items():
        if name in words:
            words |= set(re.findall(r"\w+", sql))
    for name in TABLES:
        if name in words:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in SPARK.items():
        if name in words:
            spark.sql(sql).createOrReplaceTempView(name)


def oracle(text: str) -> str:
    """text in DuckDB's dialect, with the relations that it names in front."""
    for a, b in (("struct(", "row("), ("percentile(", "quantile_cont("), (" div ", " // ")):
        text = text.replace(a, b)
    text = re.sub(r"explode\(sequence\(", "unnest(generate_series(", text)
    text = re.sub(r"(first|last)_value\(([^()]*)\) IGNORE NULLS", r"\1_value(\2 IGNORE NULLS)", text)
    words = set(re.findall(r"\w+", text))
    front = ", ".join(f"{name} AS ({sql})" for name, sql in DUCKDB.items() if name in words)
    if not front:
        return text
    body = text.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {front}, {body[14:]}"
    return f"WITH {front}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {front} {body}"
