"""Scans, sinks and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.nearest import nearest_by_value, nearest_earlier
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.files import json_lines, sorted_sink, through, torn_lines
from tidemark.sources.scratch import path, written
from tidemark.sources.tables import table

_EVENTS = "SELECT event_id, user_id, kind FROM ev"


@query("parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_totalprice")


@query("parquet_sink_sorted", oracle("SELECT mint, slot, txi, cents FROM trades WHERE mint < 100"))
def parquet_sink_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = path(spark, "sorted")
    sorted_sink(run(spark, sf_dir, "SELECT mint, slot, txi, cents FROM trades"), at, ["mint", "slot", "txi"])
    return spark.read.parquet(at).where("mint < 100")


@query("parquet_glob_partitioned", oracle("SELECT d div 365 AS year_, count(*) AS n FROM trades WHERE d div 365 >= 3 GROUP BY 1"))
def parquet_glob_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = path(spark, "by-year")
    sorted_sink(run(spark, sf_dir, "SELECT d div 365 AS year_, mint, slot FROM trades"), at, ["mint", "slot"], "year_")
    return spark.read.parquet(at).where("year_ >= 3").groupBy(F.col("year_").cast("long").alias("year_")).agg(F.count("*").alias("n"))


@query("json_scan", oracle(_EVENTS))
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines(spark, through(run(spark, sf_dir, _EVENTS), "json", "json"), "event_id long, user_id long, kind string").drop("_corrupt")


@query("jsonl_tolerant_read", oracle("SELECT event_id % 100 = 7 AS malformed, count(*) AS n FROM ev GROUP BY 1"))
def jsonl_tolerant_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = written(json_lines(spark, torn_lines(run(spark, sf_dir, _EVENTS), "torn"), "event_id long, user_id long, kind string"), "parsed")
    return read.select(F.col("_corrupt").isNotNull().alias("malformed"), "event_id").groupBy("malformed").agg(F.count("*").alias("n"))


@query("csv_or_jsonl_archive_import", oracle("SELECT event_id AS id, user_id AS wallet, kind FROM ev"))
def csv_or_jsonl_archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = through(run(spark, sf_dir, _EVENTS), "csv", "csv", header="true")
    return spark.read.schema("event_id long, user_id long, kind string").option("header", True).csv(at).select(F.col("event_id").alias("id"), F.col("user_id").alias("wallet"), "kind")


@query("jsonl_to_parquet", oracle("SELECT kind, count(*) AS n FROM ev GROUP BY kind"))
def jsonl_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = json_lines(spark, through(run(spark, sf_dir, _EVENTS), "json", "json"), "event_id long, user_id long, kind string").drop("_corrupt")
    return spark.read.parquet(through(lines, "parquet", "from-json")).groupBy("kind").agg(F.count("*").alias("n"))


@query("parquet_atomic_swap", oracle("SELECT mint, max(d) AS last FROM trades GROUP BY mint"))
def parquet_atomic_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version is a folder of its own that Spark commits whole; a reader takes the newest version named by the pointer table."""
    versions = [through(run(spark, sf_dir, f"SELECT mint, max(d) AS last FROM trades WHERE d < {most} GROUP BY mint"), "parquet", "version") for most in (900, 99999)]
    pointer = through(spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "version int, at string"), "parquet", "pointer")
    newest = spark.read.parquet(pointer).orderBy(F.desc("version")).first()["at"]
    return spark.read.parquet(newest)


@query("quantile_approx")
def quantile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "SELECT status, approx_percentile(px, array(0.25D, 0.5D, 0.75D), 1000) AS quartiles FROM trades GROUP BY status")


statement("board_snapshot_flatten", "SELECT DISTINCT mint, d, side FROM (SELECT m.mint AS mint, m.side AS side, d FROM (SELECT d, explode(members) AS m FROM (SELECT d, collect_list(struct(mint, side)) AS members FROM trades GROUP BY d) a) b) c", "SELECT DISTINCT mint, d, side FROM trades")
statement("build_stream_merge", "SELECT mint, t, src FROM (SELECT mint, t, src, row_number() OVER (PARTITION BY mint ORDER BY t, src) AS rn FROM (SELECT mint, t, 'tape' AS src FROM trades UNION ALL SELECT mint, t, 'call' AS src FROM calls) x) y WHERE rn = 1")
_FLOW = "SELECT slot, owner, mint, CAST(sum(CASE WHEN side = -1 THEN qty ELSE 0 END) AS DECIMAL(38,0)) AS pre_raw, CAST(sum(CASE WHEN side = 1 THEN qty ELSE 0 END) AS DECIMAL(38,0)) AS post_raw, CAST(sum(delta) AS DECIMAL(38,0)) AS delta_raw, count(*) AS n_accounts FROM trades GROUP BY slot, owner, mint"
statement("signed_flow_build", f"SELECT f.*, n_owners FROM ({_FLOW}) f JOIN (SELECT slot, count(DISTINCT owner) AS n_owners FROM trades GROUP BY slot) s ON s.slot = f.slot", f"SELECT f.*, n_owners FROM ({_FLOW}) f JOIN (SELECT slot AS z, count(DISTINCT owner) AS n_owners FROM trades GROUP BY slot) s ON s.z = f.slot")
statement("censoring_check", "SELECT a.mint, a.px AS by_last, b.px AS by_best, b.px - a.px AS diff FROM (SELECT mint, max_by(px, struct(t, slot, txi, owner, cents)) AS px FROM trades GROUP BY mint) a JOIN (SELECT mint, max(px) AS px FROM trades GROUP BY mint) b ON a.mint = b.mint")
_ANALOGS = "WITH v AS (SELECT call_id, caller, price, t FROM calls WHERE t >= 86400 * 1260), c AS (SELECT call_id AS a_id, caller AS a_caller, price AS a_price, t AS a_t FROM calls WHERE t < 86400 * 1200) SELECT call_id, a_id, rank_ FROM (SELECT call_id, a_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY abs(price - a_price), CASE WHEN caller = a_caller THEN 0 ELSE 1 END, a_id) AS BIGINT) AS rank_ FROM v JOIN c ON a_t < t) x WHERE rank_ <= 3"


def _nearest(spark: SparkSession, sf_dir: str, k: int, known: DataFrame | None = None) -> DataFrame:
    """call_id, a_id, rank_: the k nearest train calls of every validation call, by the parts of temporal_partition; known: whole numbers by a_id that come along."""
    calls = run(spark, sf_dir, "SELECT call_id, caller, price, t FROM calls")
    queries = calls.where("t >= 86400 * 1260").select(F.col("call_id").alias("id"), F.col("price").alias("value"), F.col("caller").alias("kind"))
    candidates = calls.where("t < 86400 * 1200").select(F.col("call_id").alias("a_id"), F.col("price").alias("a_value"), F.col("caller").alias("a_kind"))
    if known is None:
        return nearest_by_value(queries, candidates, k).select(F.col("id").alias("call_id"), "a_id", "rank_")
    more = tuple(c for c in known.columns if c != "a_id")
    return nearest_by_value(queries, candidates.join(known, "a_id", "left").fillna(0, list(more)), k, more).select(F.col("id").alias("call_id"), "a_id", "rank_", *more)


@query("descriptive_analogs", oracle(_ANALOGS))
def descriptive_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 3)


_MODEL = "WITH v AS (SELECT call_id, caller, price, t FROM calls WHERE t >= 86400 * 1260), c AS (SELECT call_id AS a_id, caller AS a_caller, price AS a_price FROM calls WHERE t < 86400 * 1200), n AS (SELECT call_id, a_id, row_number() OVER (PARTITION BY call_id ORDER BY abs(price - a_price), CASE WHEN caller = a_caller THEN 0 ELSE 1 END, a_id) AS rn FROM v, c) SELECT call_id, count(*) AS k, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS p FROM n JOIN orders ON o_orderkey = a_id WHERE rn <= 20 GROUP BY call_id"


@query("analog_knn_model", oracle(_MODEL))
def analog_knn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a validation call ends well: the share of its 20 nearest train calls that did."""
    ended = run(spark, sf_dir, "SELECT o_orderkey AS a_id, count(*) AS n, count_if(o_orderstatus = 'F') AS well FROM orders GROUP BY o_orderkey")
    found = _nearest(spark, sf_dir, 20, ended).groupBy("call_id").agg(F.sum("n").alias("k"), F.sum("well").alias("well"))
    return found.where("k > 0").select("call_id", "k", (F.col("well") / F.col("k")).alias("p"))


_KNN = "WITH v AS (SELECT call_id, price, mint, t FROM calls WHERE call_id % 20 = 0), c AS (SELECT call_id AS a_id, price AS a_price, mint AS a_mint, t AS a_t FROM calls) SELECT call_id, a_id, rank_ FROM (SELECT call_id, a_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY abs(price - a_price) / 1000 + abs(mint - a_mint), a_id) AS BIGINT) AS rank_ FROM v JOIN c ON a_t < t) x WHERE rank_ <= 5"


@query("knn_topk", oracle(_KNN))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all earlier calls, for the calls whose call_id is divisible by 20."""
    found = nearest_earlier(run(spark, sf_dir, "SELECT call_id, price, mint, t FROM calls"), F.col("call_id") % 20 == 0, 5)
    rank = F.row_number().over(Window.partitionBy("call_id").orderBy("far", "a_id")).cast("long")
    return found.withColumn("rank_", rank).where("rank_ <= 5").select("call_id", "a_id", "rank_")


statement("find_rip", "SELECT mint, min(d) AS ripped FROM (SELECT mint, d, px, max(px) OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high, max(px) OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS after FROM trades) x WHERE after < 0.9999 * high GROUP BY mint")
statement("workability_census", "SELECT tier, count(*) AS n FROM (SELECT mint, CASE WHEN count(*) >= 40 THEN 'deep' WHEN count(*) >= 20 THEN 'thin' ELSE 'none' END AS tier FROM trades GROUP BY mint) x GROUP BY tier")
statement("birth_features", "SELECT l.mint, count(DISTINCT l.owner) AS snipers, max(CASE WHEN side = 1 THEN qty END) AS dev_buy FROM trades l JOIN (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint) b ON b.mint = l.mint AND l.d = b.d0 GROUP BY l.mint")
statement("trade_prints_from_tx", "SELECT slot, owner, mint, CASE WHEN sum(delta) > 0 THEN 'buy' ELSE 'sell' END AS side_, CAST(abs(sum(delta)) AS BIGINT) AS size FROM trades GROUP BY slot, owner, mint HAVING sum(delta) <> 0")
statement("value_attribution", "SELECT owner, CAST(sum(CASE WHEN side = 1 THEN -cents ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN side = -1 THEN cents ELSE 0 END) AS BIGINT) AS sold, CAST(sum(-side * cents) AS BIGINT) AS total FROM trades GROUP BY owner")
statement("leave_one_coin_out", "SELECT fold, count(*) FILTER (WHERE mint % 5 = fold) AS test, count(*) FILTER (WHERE mint % 5 <> fold) AS train FROM trades, (VALUES (0), (1), (2), (3), (4)) AS f(fold) GROUP BY fold")
