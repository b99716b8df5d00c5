"""Joins: equi, semi and anti, as-of, range and interval joins."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.joins import asof_join, range_join
from tidemark.functions.nearest import overlaps
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.scratch import written

statement("inner_equi_join_using", "SELECT b.mint, b.owner, count(*) AS n FROM trades b JOIN (SELECT mint, owner, max(d) AS last FROM trades GROUP BY mint, owner) s USING (mint, owner) WHERE b.d = s.last GROUP BY b.mint, b.owner")
statement("left_outer_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
statement("anti_join_via_null", "WITH b AS (SELECT mint, min(d) AS lo, max(d) AS hi FROM trades GROUP BY mint), g AS (SELECT mint, explode(sequence(lo, hi)) AS d FROM b), m AS (SELECT DISTINCT mint, d FROM trades) SELECT g.mint, g.d FROM g LEFT JOIN m ON g.mint = m.mint AND g.d = m.d WHERE m.d IS NULL")
statement("not_exists_latest", "SELECT mint, call_id, t FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY t DESC, call_id DESC) AS rn FROM calls) x WHERE rn = 1", "SELECT a.mint, a.call_id, a.t FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.mint = a.mint AND (b.t > a.t OR b.t = a.t AND b.call_id > a.call_id))")
statement("exists_semi", "SELECT doc_id FROM documents WHERE exists(split(text, ' '), w -> length(w) > 20)", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: length(w) > 20)) > 0")
statement("semi_join", "SELECT mint, owner, slot, txi, delta FROM trades l LEFT SEMI JOIN calls c ON c.mint = l.mint", "SELECT mint, owner, slot, txi, delta FROM trades l WHERE EXISTS (SELECT 1 FROM calls c WHERE c.mint = l.mint)")
statement("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT owner FROM trades WHERE delta < -49 AND discount > 0.09)")
statement("range_bucket_join", "SELECT lo, hi, count(*) AS n, CAST(sum(delta) AS BIGINT) AS flow FROM trades JOIN (VALUES (0, 500), (500, 1500), (1500, 2600)) AS b(lo, hi) ON d >= lo AND d < hi GROUP BY lo, hi")
statement("cross_join_values", "SELECT n_nationkey, lo FROM nation, (VALUES (0), (30), (60)) AS b(lo)")
statement("fixed_gap_self_join", "WITH g AS (SELECT mint, d, max(px) AS px FROM trades GROUP BY mint, d), gaps AS (SELECT explode(sequence(CAST(1 AS BIGINT), 5)) AS gap) SELECT gap, count(*) AS n, min(b.px - a.px) AS least FROM g a JOIN gaps ON true JOIN g b ON b.mint = a.mint AND b.d = a.d + gap GROUP BY gap")
statement("birth_event_key_join", "SELECT l.mint, l.owner, l.delta FROM trades l JOIN (SELECT mint, min(slot) AS slot FROM trades GROUP BY mint) b ON l.mint = b.mint AND l.slot = b.slot")
statement("dictionary_join", "SELECT p_name, s_name, count(*) AS n FROM trades JOIN part ON p_partkey = mint JOIN supplier ON s_suppkey = owner GROUP BY p_name, s_name")
statement("outcome_join_by_event", "SELECT call_id, CASE WHEN o.known IS NULL THEN 'missing' WHEN o.known > 86400 * 1500 THEN 'not_yet_known' ELSE 'resolved' END AS label_status FROM calls c LEFT JOIN (SELECT slot, max(t) + 86400 AS known FROM trades GROUP BY slot) o ON o.slot = c.call_id")
statement("hunch_outcome_join", "SELECT call_id, caller, n, flow FROM calls JOIN (SELECT slot, count(*) AS n, CAST(sum(delta) AS BIGINT) AS flow FROM trades GROUP BY slot) o ON o.slot = call_id")
_SETS = "SELECT slot, min(d) AS d, collect_set(owner) AS owners FROM trades GROUP BY slot"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(run(spark, sf_dir, _SETS), "owner-sets")


@query("crew_best_jaccard_join", oracle("""WITH s AS (SELECT DISTINCT slot, owner FROM trades), n AS (SELECT slot, count(*) AS n FROM s GROUP BY slot),
 o AS (SELECT a.slot AS q, b.slot AS m, count(*) AS overlap FROM s a JOIN s b ON a.owner = b.owner AND a.slot <> b.slot GROUP BY a.slot, b.slot),
 j AS (SELECT q, m, overlap, CAST(overlap AS DOUBLE) / (x.n + y.n - overlap) AS jaccard FROM o JOIN n x ON x.slot = q JOIN n y ON y.slot = m WHERE overlap >= 2)
SELECT q, m, overlap, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, overlap DESC, m) AS rn FROM j) z WHERE rn = 1"""))
def crew_best_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("jaccard", "overlap", (-F.col("m")).alias("m"))).alias("x")
    return overlaps(_sets(spark, sf_dir), False).groupBy("q").agg(best).select("q", (-F.col("x.m")).alias("m"), "x.overlap", "x.jaccard")


@query("crew_best_match", oracle("""WITH s AS (SELECT DISTINCT slot, owner, d FROM trades), n AS (SELECT slot, count(DISTINCT owner) AS n, min(d) AS d FROM s GROUP BY slot),
 o AS (SELECT a.slot AS q, b.slot AS m, count(DISTINCT a.owner) AS overlap FROM s a JOIN s b ON a.owner = b.owner GROUP BY a.slot, b.slot)
SELECT q, max(CAST(overlap AS DOUBLE) / (x.n + y.n - overlap)) AS best FROM o JOIN n x ON x.slot = q JOIN n y ON y.slot = m WHERE y.d < x.d GROUP BY q"""))
def crew_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best Jaccard of each slot's owners with those of a slot of an earlier day. Of those that share one owner alone the smallest is best, and a running minimum along the owner's days knows its size."""
    sets = _sets(spark, sf_dir)
    before = Window.partitionBy("owner").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
    holds = sets.select("slot", "d", F.size("owners").alias("n"), F.explode("owners").alias("owner")).withColumn("m_n", F.min("n").over(before))
    single = holds.where("m_n IS NOT NULL").select(F.col("slot").alias("q"), (1 / (F.col("n") + F.col("m_n") - 1)).alias("jaccard"))
    return overlaps(sets, True).select("q", "jaccard").unionByName(single).groupBy("q").agg(F.max("jaccard").alias("best"))


statement("co_trade_slot_window_join", "SELECT least(a.owner, b.owner) AS w1, greatest(a.owner, b.owner) AS w2, count(*) AS n FROM trades a JOIN trades b ON a.mint = b.mint AND abs(a.d - b.d) <= 3 AND a.owner < b.owner GROUP BY 1, 2")
statement("prebuyers", "SELECT l.owner, count(DISTINCT c.call_id) AS n FROM calls c JOIN trades l ON l.mint = c.mint AND l.t < c.t AND l.t >= c.t - 86400 * 10 AND l.side = 1 GROUP BY l.owner")
statement("arrival_count_window", "SELECT c.call_id, count(l.mint) AS n FROM calls c LEFT JOIN trades l ON l.mint = c.mint AND l.t >= c.t AND l.t < c.t + 86400 * 20 GROUP BY c.call_id")
statement("deployer_history", "SELECT o_custkey AS deployer, count(*) AS launches, count(*) FILTER (WHERE o_orderstatus = 'F') AS rips, count(*) FILTER (WHERE o_orderstatus = 'P') AS dumps FROM orders GROUP BY o_custkey")
statement("sniper_prior_max", "SELECT slot, max(n) AS prior_max FROM trades JOIN (SELECT owner, count(*) AS n FROM trades WHERE d < 800 GROUP BY owner) p USING (owner) WHERE d >= 800 GROUP BY slot")
statement("mint_leg_netting", "SELECT slot, coalesce(a.owner, b.owner) AS owner, coalesce(b.q, 0) - coalesce(a.q, 0) AS net FROM (SELECT slot, owner, CAST(sum(qty) AS BIGINT) AS q FROM trades WHERE side = -1 GROUP BY slot, owner) a FULL OUTER JOIN (SELECT slot, owner, CAST(sum(qty) AS BIGINT) AS q FROM trades WHERE side = 1 GROUP BY slot, owner) b USING (slot) WHERE a.owner = b.owner OR a.owner IS NULL OR b.owner IS NULL")
statement("effect_between", "SELECT coalesce(a.owner, b.owner) AS owner, coalesce(b.q, 0) - coalesce(a.q, 0) AS effect FROM (SELECT owner, CAST(sum(delta) AS BIGINT) AS q FROM trades WHERE d < 1000 GROUP BY owner) a FULL OUTER JOIN (SELECT owner, CAST(sum(delta) AS BIGINT) AS q FROM trades WHERE d < 1600 GROUP BY owner) b ON a.owner = b.owner")
statement("feature_bag_merge", "SELECT coalesce(a.mint, b.mint) AS mint, greatest(a.n, b.n) AS n, coalesce(a.top, b.top) AS top FROM (SELECT mint, count(*) AS n, max(CASE WHEN side = -1 THEN px END) AS top FROM trades WHERE d < 1200 GROUP BY mint) a FULL OUTER JOIN (SELECT mint, count(*) AS n, max(px) AS top FROM trades WHERE d >= 1200 GROUP BY mint) b ON a.mint = b.mint")
statement("live_closes_filter", "SELECT slot, txi, owner, cents FROM trades l LEFT ANTI JOIN (SELECT call_id FROM calls WHERE caller = 5) r ON r.call_id = l.slot", "SELECT slot, txi, owner, cents FROM trades l WHERE NOT EXISTS (SELECT 1 FROM calls r WHERE caller = 5 AND r.call_id = l.slot)")
statement("insert_or_ignore", "SELECT mint, call_id FROM (SELECT mint, call_id, row_number() OVER (PARTITION BY mint ORDER BY t, call_id) AS rn FROM calls) x WHERE rn = 1")
statement("upsert_on_conflict", "SELECT caller, call_id, price FROM (SELECT caller, call_id, price, row_number() OVER (PARTITION BY caller ORDER BY t DESC, call_id DESC) AS rn FROM calls) x WHERE rn = 1")
statement("conflict_detect", "SELECT mint, d, count(DISTINCT px) AS versions FROM trades GROUP BY mint, d HAVING count(DISTINCT px) > 1")
statement("tape_vs_vendor_reconcile", "SELECT CASE WHEN abs(a.px - p_retailprice / 1000) < 0.5 THEN 'close' ELSE 'off' END AS bucket, count(*) AS n FROM (SELECT mint, max_by(px, struct(t, slot, txi, owner, cents)) AS px FROM trades GROUP BY mint) a JOIN part ON p_partkey = a.mint GROUP BY 1")

_LAST = "SELECT mint, t, max(px) AS px FROM trades GROUP BY mint, t"


@query("asof_join_backward", oracle(f"SELECT call_id, CASE WHEN c.t - s.t <= 86400 * 30 THEN s.t END AS mark_t, CASE WHEN c.t - s.t <= 86400 * 30 THEN s.px END AS px FROM calls c ASOF LEFT JOIN ({_LAST}) s ON c.mint = s.mint AND c.t >= s.t"))
def asof_join_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price at or before each call; a match older than the tolerance is dropped, not replaced."""
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    fresh = F.col("t") - F.col("right_t") <= 86400 * 30
    return asof_join(calls, trades, "mint", "t", ["px"]).select("call_id", F.when(fresh, F.col("right_t")).alias("mark_t"), F.when(fresh, F.col("px")).alias("px"))


@query("asof_staleness_mark", oracle(f"SELECT call_id, s.px, c.t - s.t AS staleness, c.t - s.t <= 86400 * 7 AS live FROM calls c ASOF LEFT JOIN ({_LAST}) s ON c.mint = s.mint AND c.t >= s.t"))
def asof_staleness_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    age = F.col("t") - F.col("right_t")
    return asof_join(calls, trades, "mint", "t", ["px"]).select("call_id", "px", age.alias("staleness"), (age <= 86400 * 7).alias("live"))


@query("asof_last_fill_stale_bound", oracle(f"SELECT call_id, s.px FROM calls c ASOF JOIN (SELECT mint, t, max(px) AS px FROM trades WHERE side = 1 GROUP BY mint, t) s ON c.mint = s.mint AND c.t >= s.t WHERE c.t - s.t < 86400 * 20"))
def asof_last_fill_stale_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, fills = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades WHERE side = 1")
    return asof_join(calls, fills, "mint", "t", ["px"]).where(F.col("t") - F.col("right_t") < 86400 * 20).select("call_id", "px")


@query("value_at_or_after", oracle(f"SELECT call_id, CASE WHEN s.t - c.t <= 86400 * 30 THEN s.px END AS px FROM calls c ASOF LEFT JOIN ({_LAST}) s ON c.mint = s.mint AND c.t <= s.t"))
def value_at_or_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    return asof_join(calls, trades, "mint", "t", ["px"], forward=True).select("call_id", F.when(F.col("right_t") - F.col("t") <= 86400 * 30, F.col("px")).alias("px"))


@query("step_prices_lookup", oracle(f"SELECT call_id, s.px FROM calls c ASOF LEFT JOIN ({_LAST}) s ON c.mint = s.mint AND c.t >= s.t"))
def step_prices_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    return asof_join(calls, trades, "mint", "t", ["px"]).select("call_id", "px")


@query("board_forward_returns", oracle(f"SELECT x.call_id, y.px / x.px - 1 AS ret FROM (SELECT call_id, c.mint, c.t + 86400 * 30 AS t, s.px FROM calls c ASOF JOIN ({_LAST}) s ON c.mint = s.mint AND c.t <= s.t) x ASOF JOIN ({_LAST}) y ON x.mint = y.mint AND x.t <= y.t"))
def board_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    first = asof_join(calls, trades, "mint", "t", ["px"], forward=True).where("right_t IS NOT NULL").select("call_id", "mint", (F.col("t") + 86400 * 30).alias("t"), F.col("px").alias("entry"))
    return asof_join(first, trades, "mint", "t", ["px"], forward=True).where("right_t IS NOT NULL").select("call_id", (F.col("px") / F.col("entry") - 1).alias("ret"))


@query("event_study", oracle(f"SELECT x.call_id, y.px / x.px - 1 AS ret FROM (SELECT call_id, c.mint, c.t + 86400 * 60 AS t, s.px FROM calls c ASOF JOIN ({_LAST}) s ON c.mint = s.mint AND c.t >= s.t) x ASOF JOIN ({_LAST}) y ON x.mint = y.mint AND x.t >= y.t"))
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return from the last price at the event to the last price a horizon later: nothing after either time is read."""
    calls, trades = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, px FROM trades")
    first = asof_join(calls, trades, "mint", "t", ["px"]).where("right_t IS NOT NULL").select("call_id", "mint", (F.col("t") + 86400 * 60).alias("t"), F.col("px").alias("entry"))
    return asof_join(first, trades, "mint", "t", ["px"]).select("call_id", (F.col("px") / F.col("entry") - 1).alias("ret"))


@query("temporal_prebuy_join", oracle("SELECT c.caller, l.owner, count(DISTINCT c.mint) AS mints FROM calls c JOIN trades l ON l.mint = c.mint AND l.t < c.t AND l.t >= c.t - 86400 * 15 AND l.side = 1 GROUP BY c.caller, l.owner"))
def temporal_prebuy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, buys = run(spark, sf_dir, "SELECT caller, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, owner FROM trades WHERE side = 1")
    return range_join(calls, buys, "mint", "t", 86400 * 15, ["owner"]).groupBy("caller", "owner").agg(F.countDistinct("mint").alias("mints"))


@query("interval_self_join_pairs", oracle("SELECT a.mint, a.t, b.t AS right_t FROM (SELECT DISTINCT mint, t FROM trades) a JOIN (SELECT DISTINCT mint, t FROM trades) b ON a.mint = b.mint AND b.t - a.t > 0 AND b.t - a.t <= 86400 * 12 AND b.t - a.t >= 86400 * 8"))
def interval_self_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = run(spark, sf_dir, "SELECT DISTINCT mint, t FROM trades")
    return range_join(times, times, "mint", "t", 86400 * 12, [], before=False).where(F.col("right_t") - F.col("t") >= 86400 * 8)


@query("social_latest_as_known_join", oracle("SELECT call_id, slot, owner FROM (SELECT c.call_id, l.slot, l.owner, row_number() OVER (PARTITION BY c.call_id ORDER BY l.t DESC, l.slot DESC, l.txi DESC, l.owner DESC, l.cents DESC) AS rn FROM calls c JOIN trades l ON l.mint = c.mint AND l.t < c.t AND l.t >= c.t - 86400 * 60 AND l.slot <= c.call_id + 40000) x WHERE rn = 1"))
def social_latest_as_known_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, facts = run(spark, sf_dir, "SELECT call_id, mint, t FROM calls"), run(spark, sf_dir, "SELECT mint, t, slot, txi, owner, cents FROM trades")
    seen = range_join(calls, facts, "mint", "t", 86400 * 60, ["slot", "txi", "owner", "cents"]).where("slot <= call_id + 40000")
    return seen.groupBy("call_id").agg(F.max(F.struct("right_t", "slot", "txi", "owner", "cents")).alias("x")).select("call_id", "x.slot", "x.owner")
