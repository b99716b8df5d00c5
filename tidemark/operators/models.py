"""Fitted models over the tape; SQL cannot iterate to convergence, so tests compare them with plain numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fitting
from tidemark.operators.registry import query
from tidemark.operators.sql import run
from tidemark.sources.scratch import written

FEATURES = ["discount", "tax", "qty", "log_px"]
_ROWS = "SELECT mint, owner, d, CASE WHEN side = -1 THEN 1 ELSE 0 END AS y, discount, tax, qty, ln(px) AS log_px, 2 * discount AS twice, 1 AS same FROM trades"


def _rows(spark: SparkSession, sf_dir: str, text: str = _ROWS) -> DataFrame:
    return written(run(spark, sf_dir, text), "model-rows")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], schema)


@query("usable_columns")
def usable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, fitting.usable(_rows(spark, sf_dir), [*FEATURES, "twice", "same"]), "column_ string, verdict string")


@query("logistic_irls")
def logistic_irls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted by quantity, L2 of 1."""
    beta, _, _ = fitting.logistic(_rows(spark, sf_dir), FEATURES, "y", 1.0, "qty")
    return _table(spark, list(zip(["intercept", *FEATURES], map(float, beta), strict=True)), "term string, coefficient double")


@query("logistic_sklearn")
def logistic_sklearn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted before day 1200 with an L2 of 1, scored from there on: calls of each tenth of the score, and how many were right."""
    rows = _rows(spark, sf_dir)
    train = rows.where("d < 1200")
    beta, _, x = fitting.logistic(train, FEATURES, "y", 1.0)
    score = 1 / (1 + F.exp(-fitting._linear(x, beta)))
    return rows.where("d >= 1200").groupBy(F.floor(score * 10).alias("tenth")).agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.round(F.avg(score), 6).alias("mean_score"))


@query("clustered_logit")
def clustered_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    names = [n for n, v in fitting.usable(rows, [*FEATURES, "twice", "same"]) if v == "kept"]
    beta, bread, x = fitting.logistic(rows, names, "y")
    errors = fitting.clustered(rows, beta, bread, x, "y", "mint")
    return _table(spark, list(zip(["intercept", *names], map(float, beta), map(float, errors), strict=True)), "term string, coefficient double, se double")


@query("cox_ph")
def cox_ph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "SELECT o_orderkey % 60 + 1 AS time_to, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS died, ln(o_totalprice) AS log_price, o_custkey % 97 AS caller FROM orders")
    beta, errors = fitting.cox(rows, ["log_price", "caller"], "time_to", "died")
    return _table(spark, list(zip(["log_price", "caller"], map(float, beta), map(float, errors), strict=True)), "term string, coefficient double, se double")


@query("empirical_bayes_pool")
def empirical_bayes_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = _rows(spark, sf_dir, "SELECT mint, ln((a + 0.5D) / (b + 0.5D)) AS effect, 1 / (a + 0.5D) + 1 / (b + 0.5D) AS variance FROM (SELECT mint, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = -1) AS b FROM trades GROUP BY mint) x")
    return _table(spark, [tuple(map(float, fitting.partial_pool(effects, "effect", "variance")))], "mean double, se double, spread double")


@query("gbm_hist")
def gbm_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted before day 1200, scored from there on: trades of each tenth of the score, and how many were sales."""
    rows = _rows(spark, sf_dir)
    trees = fitting.boosted(rows.where("d < 1200"), FEATURES, "y")
    score = 1 / (1 + F.exp(-fitting.boosted_score(trees)))
    return rows.where("d >= 1200").groupBy(F.floor(score * 10).alias("tenth")).agg(F.count("*").alias("n"), F.sum("y").alias("positive"), F.round(F.avg(score), 6).alias("mean_score"))


@query("hodge_decompose")
def hodge_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the money that goes from customers' to suppliers' nations: the shares that flow down potentials, around triangles, and neither. As many edges as pairs of nations."""
    edges = run(spark, sf_dir, "SELECT c_nationkey AS a, s_nationkey AS b, CAST(sum(cents) AS DOUBLE) AS v FROM trades JOIN orders ON o_orderkey = slot JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = owner WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey")
    return _table(spark, [fitting.hodge([tuple(r) for r in edges.collect()])], "gradient double, curl double, harmonic double")
