"""Operators whose plan is one SQL statement over the tape's relations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.registry import query
from tidemark.plans.tape import oracle, views


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    views(spark, sf_dir, text)
    return spark.sql(text)


def statement(name: str, text: str, duckdb: str | None = None) -> None:
    """Register text under name; duckdb: the oracle where it needs a text of its own."""

    @query(name, oracle(duckdb or text))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, text)


def q(expression: str, digits: int = 4) -> str:
    """A double that was summed in some order, cut to digits that do not depend on it."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def cut(expression: str, digits: int) -> str:
    """As q, for values that are often halfway between two of so many digits: the border lies beside the half."""
    return f"floor(({expression}) * 1e{digits} + 0.4371) / 1e{digits}"


def exact(expression: str) -> str:
    """A sum of money or quantities that does not depend on the order: decimals of two places, as a double."""
    return f"CAST(sum(CAST({expression} AS DECIMAL(18, 2))) AS DOUBLE)"


def hashed(e: str, dialect: str) -> str:
    """A number in 0..2**32-1 from a string, the same in both engines: the randomness of resampling, which a job run again repeats."""
    return f"CAST(conv(substr(md5({e}), 1, 8), 16, 10) AS BIGINT)" if dialect == "spark" else f"CAST(('0x' || substr(md5({e}), 1, 8)) AS BIGINT)"


def resampled(name: str, f) -> None:
    """Register f(h), a statement in which h(string expression) draws a number."""
    statement(name, f(lambda e: hashed(e, "spark")), f(lambda e: hashed(e, "duckdb")))


def poisson(u: str) -> str:
    """A count with a mean of 1 from u in 0..2**32-1: how often a bootstrap replicate takes an entity (to 8 times), drawn without numbering entities."""
    ends, c, p = [], 0.0, math.exp(-1)
    for k in range(8):
        c += p
        p /= k + 1
        ends.append(int(c * 2**32))
    return "CASE " + " ".join(f"WHEN {u} < {e} THEN {k}" for k, e in enumerate(ends)) + " ELSE 8 END"
