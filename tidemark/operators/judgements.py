"""Scores, classes and gates of texts, callers, venues and pools, by rules on what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.operators.sql import q, statement
from tidemark.sources.scratch import path

_ORDER = "d, slot, txi, owner, cents"

# Allowed keys only, names by digest, at most 120 characters; what was cut says so.
_REDACTED = "WITH r AS (SELECT c_custkey, {json} AS doc FROM customer) SELECT c_custkey, left(doc, 120) AS doc, length(doc) > 120 AS cut_ FROM r"
statement(
    "redacting_projection",
    _REDACTED.format(json="to_json(named_struct('id', c_custkey, 'name', substr(md5(c_name), 1, 12), 'nation', c_nationkey, 'segment', c_mktsegment))"),
    _REDACTED.format(json="""'{"id":' || c_custkey || ',"name":"' || substr(md5(c_name), 1, 12) || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}'"""),
)

# Points for length, for few links and marks, and for words that are not the same over and over; from 0 to 100.
_QUALITY = """WITH f AS (SELECT doc_id, length(coalesce(text, '')) AS n, {links} AS links, {bangs} AS bangs, {words} AS words, {different} AS different FROM documents)
SELECT doc_id, CAST(greatest(0, least(100, CASE WHEN n >= 400 THEN 40 WHEN n >= 100 THEN 25 WHEN n > 0 THEN 10 ELSE 0 END + CASE WHEN words > 0 THEN (50 * different) div words ELSE 0 END + 10 - 10 * least(links, 4) - 5 * least(bangs, 6))) AS INT) AS score, CASE WHEN n = 0 THEN 'empty' WHEN links > 3 OR bangs > 5 THEN 'promotional' WHEN words >= 20 AND different * 4 < words THEN 'repetitive' ELSE 'plain' END AS class FROM f"""
statement(
    "score_mention_quality",
    _QUALITY.format(links="regexp_count(coalesce(text, ''), 'https?://')", bangs="regexp_count(coalesce(text, ''), '!!')", words="size(filter(split(lower(coalesce(text, '')), '[ \\\\n]+'), x -> x <> ''))", different="size(array_distinct(filter(split(lower(coalesce(text, '')), '[ \\\\n]+'), x -> x <> '')))"),
    _QUALITY.format(links="len(regexp_extract_all(coalesce(text, ''), 'https?://'))", bangs="len(regexp_extract_all(coalesce(text, ''), '!!'))", words="len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\n]+'), lambda x: x <> ''))", different="len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\n]+'), lambda x: x <> '')))"),
)

# Quotes of a curve with virtual reserves and a fee of 100 bps on the money side; what cannot be quoted is refused by name.
statement(
    "pump_quote",
    """WITH r AS (SELECT slot, txi, owner, side, qty, cents, 1000000 + mint * 100 AS tokens, CAST(3000000000 AS BIGINT) + mint AS money FROM trades),
 n AS (SELECT *, cents * 9900 div 10000 AS net FROM r), o AS (SELECT *, CASE WHEN side = 1 THEN tokens * net div (money + net) ELSE (money * qty div (tokens + qty)) * 9900 div 10000 END AS out FROM n)
SELECT slot, txi, owner, side, CASE WHEN out <= 0 THEN 'refused_dust' WHEN side = 1 AND out * 10 > tokens THEN 'refused_depth' WHEN side = -1 AND out * 10 > money THEN 'refused_depth' ELSE 'ok' END AS status, CASE WHEN out > 0 AND out * 10 <= CASE WHEN side = 1 THEN tokens ELSE money END THEN out END AS out FROM o""",
)

# One trade for each transaction and coin: legs rank by evidence (settled, then the larger one); a sign needs all legs of the best rank to agree.
statement(
    "trade_collapse",
    """WITH l AS (SELECT slot, mint, owner, side, qty, cents, CASE WHEN status = 'F' THEN 1 ELSE 2 END AS evidence FROM trades), b AS (SELECT slot, mint, min(evidence) AS evidence FROM l GROUP BY slot, mint)
SELECT l.slot, l.mint, b.evidence AS evidence_rank, max_by(owner, struct(qty, cents, owner)) AS venue, count(*) AS legs, count(DISTINCT owner) AS n_parties, CASE WHEN min(side) = max(side) THEN max(side) ELSE 0 END AS trade_sign, CASE WHEN min(side) <> max(side) THEN 'conflict' WHEN count(*) = 1 THEN 'exact' ELSE 'summed' END AS quality, CAST(sum(qty) AS BIGINT) AS units FROM l JOIN b ON b.slot = l.slot AND b.mint = l.mint AND b.evidence = l.evidence GROUP BY l.slot, l.mint, b.evidence""",
)

# Every user asks for one kind of event with a floor of its own; standing subscriptions meet events on user and kind.
statement("subscription_match", "WITH s AS (SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN 'purchase' WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'error' ELSE 'signup' END AS wanted, user_id % 40 AS floor_ FROM ev) SELECT ev.event_id, ev.user_id, s.wanted, row_number() OVER (PARTITION BY ev.user_id ORDER BY ev.t, ev.event_id) AS delivery FROM ev JOIN s ON s.user_id = ev.user_id AND s.wanted = ev.kind AND ev.value >= s.floor_")


@query("cursor_tail", "SELECT user_id, max(event_id) AS cursor, count(*) AS n FROM events GROUP BY user_id")
def cursor_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder is followed, left, and taken up again where the cursor (the stream's checkpoint) stands: no event is lost or comes twice."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    at, out = path(spark, "cursor-source"), path(spark, "cursor")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.mode("append").parquet(at)
        stream = spark.readStream.schema(rows.schema).parquet(at)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("user_id").agg(F.max("event_id").alias("cursor"), F.count("*").alias("n"))


# A call's forecast is its caller's record strictly before it, shrunk to a half; scored by the parts of the split.
statement(
    "prediction_eval",
    f"""WITH c AS (SELECT call_id, caller, t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM calls JOIN orders ON o_orderkey = call_id WHERE o_orderstatus <> 'P'),
 p AS (SELECT *, (coalesce(sum(y) OVER w, 0) + 1) / CAST(count(*) OVER w + 2 AS DOUBLE) AS p FROM c WINDOW w AS (PARTITION BY caller ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN t < 86400 * 1200 THEN 'train' WHEN t < 86400 * 1260 THEN 'excluded_embargo' ELSE 'validation' END AS part, count(*) AS n, {q('avg((p - y) * (p - y))', 7)} AS brier, {q('avg(p)', 7)} AS mean_forecast, {q('avg(CAST(y AS DOUBLE))', 7)} AS base_rate FROM p GROUP BY 1""",
)

# Two venues of one market (settled and open lines): the daily steps of the log of their price ratio.
statement("realized_vol_pair", f"WITH s AS (SELECT status, d, ln(max_by(px, struct(slot, txi, mint, owner, cents))) AS l FROM trades GROUP BY status, d), r AS (SELECT a.d, a.l - b.l AS x FROM s a JOIN s b ON a.d = b.d AND a.status = 'F' AND b.status = 'O'), g AS (SELECT d, x - lag(x) OVER (ORDER BY d) AS dx, d - lag(d) OVER (ORDER BY d) AS gap FROM r) SELECT count(dx) AS steps, {q('stddev_samp(dx / sqrt(CAST(gap AS DOUBLE)))', 6)} AS vol, {q('avg(dx)', 6)} AS drift FROM g")

# A caller's rhythm and range: too few calls, evenly timed ones, one coin over and over, or a person's.
statement(
    "caller_class",
    f"""WITH g AS (SELECT caller, mint, t - lag(t) OVER (PARTITION BY caller ORDER BY t, call_id) AS gap FROM calls), c AS (SELECT caller, count(*) AS n, count(DISTINCT mint) AS mints, {q('stddev_pop(CAST(gap AS DOUBLE)) / nullif(avg(CAST(gap AS DOUBLE)), 0)', 6)} AS unevenness FROM g GROUP BY caller)
SELECT caller, n, mints, unevenness, CASE WHEN n < 5 THEN 'sparse' WHEN unevenness < 0.5 THEN 'timer' WHEN mints * 2 < n THEN 'repeater' ELSE 'human' END AS class FROM c""",
)

# Evidence for a call: a trade of the mint on its day, within a week before, or none.
statement(
    "evidence_tier",
    "WITH c AS (SELECT call_id, mint, t div 86400 AS d FROM calls), b AS (SELECT mint, d, 0 AS o, CAST(NULL AS BIGINT) AS call_id FROM (SELECT DISTINCT mint, d FROM trades) x UNION ALL SELECT mint, d, 1, call_id FROM c), n AS (SELECT call_id, o, d, last_value(CASE WHEN o = 0 THEN d END) IGNORE NULLS OVER (PARTITION BY mint ORDER BY d, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM b) SELECT call_id, CASE WHEN last = d THEN 'direct' WHEN last >= d - 7 THEN 'inferred' ELSE 'weak' END AS tier, d - last AS age_days FROM n WHERE o = 1",
    "WITH c AS (SELECT call_id, mint, t // 86400 AS d FROM calls), n AS (SELECT c.*, (SELECT max(l.d) FROM trades l WHERE l.mint = c.mint AND l.d <= c.d) AS last FROM c) SELECT call_id, CASE WHEN last = d THEN 'direct' WHEN last >= d - 7 THEN 'inferred' ELSE 'weak' END AS tier, d - last AS age_days FROM n",
)

# What a coin's traders paid, in ten-thousandths of what they traded; both parts in whole cents.
statement("effective_fee_bps", f"SELECT mint, CAST(sum(CAST(floor(cents * discount + 0.0001) AS BIGINT) + CAST(floor(cents * tax + 0.0001) AS BIGINT)) AS BIGINT) AS fee_cents, CAST(sum(cents) AS BIGINT) AS cents, {q('10000 * CAST(sum(CAST(floor(cents * discount + 0.0001) AS BIGINT) + CAST(floor(cents * tax + 0.0001) AS BIGINT)) AS DOUBLE) / sum(cents)', 4)} AS fee_bps FROM trades GROUP BY mint")
# Fees of the year on the value locked on average, and turnover of that value; the gate opens if fees beat an eighth of the variance.
_POOL = f"g AS (SELECT mint, d, cents, cents * tax AS fee, greatest(sum(delta) OVER w, 0) * px * 100 AS locked, ln(px) - lag(ln(px)) OVER w AS r FROM trades WINDOW w AS (PARTITION BY mint ORDER BY {_ORDER})), p AS (SELECT mint, greatest(max(d) - min(d), 1) / CAST(365 AS DOUBLE) AS years, sum(fee) AS fees, CAST(sum(cents) AS DOUBLE) AS volume, avg(locked) AS locked, sum(r * r) AS v, count(*) AS n FROM g GROUP BY mint HAVING count(*) > 2), l AS (SELECT * FROM p WHERE locked > 0 AND v > 0)"
statement("fee_rate_annualised", f"WITH {_POOL} SELECT mint, {q('fees / locked / years', 6)} AS per_year, {q('fees / locked / years / 365', 9)} AS per_day FROM l")
statement("turnover_model", f"WITH {_POOL}, t AS (SELECT mint, ln(volume / locked / years) AS turnover, ln(fees / volume) AS fee FROM l WHERE fees > 0) SELECT count(*) AS pools, {q('regr_slope(turnover, fee)', 5)} AS elasticity, {q('regr_intercept(turnover, fee)', 5)} AS level, {q('regr_r2(turnover, fee)', 5)} AS r2 FROM t")
statement("toll_gate", f"WITH {_POOL} SELECT mint, {q('fees / locked / years', 6)} AS fee_side, {q('v / years / 8', 6)} AS loss_side, fees / locked > v / 8 AS open_ FROM l")
# A call's floor by tier of its coin's volume in the 90 days before it.
statement(
    "venue_fee_floor",
    f"""WITH b AS (SELECT mint, t, cents, CAST(NULL AS BIGINT) AS call_id FROM trades UNION ALL SELECT mint, t, 0, call_id FROM calls), v AS (SELECT call_id, coalesce(sum(cents) OVER (PARTITION BY mint ORDER BY t RANGE BETWEEN {86400 * 90} PRECEDING AND 1 PRECEDING), 0) AS volume FROM b)
SELECT call_id, CAST(volume AS BIGINT) AS volume, CASE WHEN volume >= 20000000 THEN 30 WHEN volume >= 5000000 THEN 60 WHEN volume > 0 THEN 95 ELSE 125 END AS floor_bps FROM v WHERE call_id IS NOT NULL""",
)
# Holders at the end: the largest one's and the first buyer's share of all units held, and how many there are.
statement(
    "organic_holder_deployer_verdicts",
    "WITH h AS (SELECT mint, owner, CAST(greatest(sum(delta), 0) AS BIGINT) AS held FROM trades GROUP BY mint, owner), b AS (SELECT mint, min_by(owner, struct(d, slot, txi, owner)) AS deployer FROM trades WHERE side = 1 GROUP BY mint), s AS (SELECT h.mint, count(*) FILTER (WHERE held > 0) AS holders, CAST(max(held) AS DOUBLE) / nullif(CAST(sum(held) AS DOUBLE), 0) AS top, CAST(sum(CASE WHEN h.owner = b.deployer THEN held ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(held) AS DOUBLE), 0) AS deployer_share FROM h LEFT JOIN b ON b.mint = h.mint GROUP BY h.mint) SELECT mint, holders, top, deployer_share, CASE WHEN holders = 0 THEN 'abandoned' WHEN deployer_share > 0.3 THEN 'deployer_held' WHEN top > 0.5 THEN 'concentrated' WHEN holders < 5 THEN 'thin' ELSE 'organic' END AS verdict FROM s",
)
