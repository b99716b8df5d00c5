"""What is known when, by which rule, and what a rule refuses: every exclusion has one reason, and a refusal is a row."""

from tidemark.operators.sql import q, statement

_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

# Each event as one of the tape's bodies, rebuilt as canonical JSON, or the first reason why not.
_BODY = "CASE kind WHEN 'purchase' THEN 'trade' WHEN 'click' THEN 'watch' WHEN 'view' THEN 'snapshot' WHEN 'signup' THEN 'birth' WHEN 'error' THEN 'defect' END"
_DECODE = f"""WITH b AS (SELECT event_id, user_id, t, value, {_BODY} AS body, try_cast({{k}} AS BIGINT) AS k FROM ev), s AS (SELECT *, CASE WHEN body IS NULL THEN 'unknown_kind' WHEN k IS NULL THEN 'missing_key' WHEN user_id IS NULL THEN 'missing_subject' WHEN body = 'trade' AND (value IS NULL OR value <= 0) THEN 'bad_amount' ELSE 'ok' END AS status FROM b)
SELECT event_id, body, status, CASE WHEN status = 'ok' THEN {{json}} END AS rebuilt FROM s"""
statement(
    "tape_event_decode",
    _DECODE.format(k="get_json_object(props, '$.k')", json="to_json(named_struct('body', body, 'key', k, 'subject', user_id, 't', t))"),
    _DECODE.format(k="json_extract_string(props, '$.k')", json="""'{"body":"' || body || '","key":' || k || ',"subject":' || user_id || ',"t":' || t || '}'"""),
)

# A version of a transaction (slot, line) is known some days after it; of those known by the cut the newest counts, and canonicality is asked before finality.
_VERSIONS = "v AS (SELECT slot, txi, owner, mint, cents, d, d + txi * 5 AS known_d, status, tax FROM trades), n AS (SELECT *, row_number() OVER (PARTITION BY slot, txi ORDER BY CASE WHEN known_d <= 1500 THEN 0 ELSE 1 END, d DESC, owner DESC, mint DESC, cents DESC) AS rn, sum(CASE WHEN known_d <= 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY slot, txi, d) AS rivals FROM v)"
_WHY = "CASE WHEN known_d > 1500 THEN 'not_available' WHEN rn > 1 THEN 'superseded' WHEN status <> 'F' THEN 'not_canonical' WHEN tax < 0.01 THEN 'not_final' WHEN rivals > 1 THEN 'ambiguous' ELSE 'accepted' END"
statement("effective_fact_reduce", f"WITH {_VERSIONS}, r AS (SELECT slot, txi, owner, mint, cents, {_WHY} AS why FROM n) SELECT slot, txi, owner, mint, CASE WHEN why = 'accepted' THEN cents END AS value, why FROM r")
statement("current_transaction_version", f"WITH {_VERSIONS} SELECT slot, txi, owner, mint, cents, known_d FROM n WHERE rn = 1 AND known_d <= 1500 AND status = 'F' AND tax >= 0.01")

_RULES = [
    ("order without customer", "orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL"),
    ("line without order", "lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL"),
    ("line without part", "lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL"),
    ("line without supplier", "lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL"),
    ("customer without nation", "customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IS NULL"),
    ("shipped before ordered", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate"),
    ("amount not positive", "lineitem WHERE NOT (l_quantity > 0 AND l_extendedprice > 0)"),
    ("rate out of range", "lineitem WHERE NOT (l_discount BETWEEN 0 AND 1 AND l_tax BETWEEN 0 AND 1)"),
    ("order named twice", "(SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1) x"),
]
statement("catalog_invariants", " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS violations FROM {of}" for name, of in _RULES))

# Every event and why it stays or goes: still in its time, referred to by a large order, a defect to be looked into, or none of these.
statement("retention_prune", "WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000), z AS (SELECT max(t) - 86400 * 10 AS cut_ FROM ev) SELECT event_id, CASE WHEN t >= cut_ THEN 'in_time' WHEN kind = 'error' THEN 'defect' WHEN k.o_custkey IS NOT NULL THEN 'referenced' ELSE 'pruned' END AS state FROM ev LEFT JOIN k ON k.o_custkey = ev.user_id, z")

# Gone only if asked for at three instants or more, over a day or longer, by two routes or more, in three hours of the day or more, and not seen since the last failure.
statement("removal_inference", "WITH e AS (SELECT user_id, max(CASE WHEN kind = 'purchase' THEN t END) AS seen, max(CASE WHEN kind IN ('error', 'view') THEN t END) AS failed, count(*) FILTER (WHERE kind IN ('error', 'view')) AS n, count(DISTINCT CASE WHEN kind IN ('error', 'view') THEN kind END) AS routes, count(DISTINCT CASE WHEN kind IN ('error', 'view') THEN (t div 3600) % 24 END) AS hours, max(CASE WHEN kind IN ('error', 'view') THEN t END) - min(CASE WHEN kind IN ('error', 'view') THEN t END) AS spread FROM ev GROUP BY user_id) SELECT user_id, n, routes, hours, CASE WHEN n < 3 THEN 'too_few' WHEN spread < 86400 THEN 'too_close' WHEN routes < 2 THEN 'one_route' WHEN hours < 3 THEN 'one_time_of_day' WHEN seen > failed THEN 'seen_since' ELSE 'removed' END AS state FROM e")

# A pool's tape with the intervals that cover it: trades no more than 30 days apart.
statement(
    "pool_tape_aggregate",
    "WITH g AS (SELECT mint, d, delta, cents, CASE WHEN d - lag(d) OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents) <= 30 THEN 0 ELSE 1 END AS opens FROM trades), i AS (SELECT mint, d, delta, cents, sum(opens) OVER (PARTITION BY mint ORDER BY d, opens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g), c AS (SELECT mint, k, min(d) AS lo, max(d) AS hi FROM i GROUP BY mint, k), v AS (SELECT mint, count(*) AS intervals, CAST(sum(hi - lo + 1) AS BIGINT) AS covered_days FROM c GROUP BY mint), a AS (SELECT mint, count(*) AS n, CAST(sum(delta) AS BIGINT) AS flow, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT d) AS active_days, min(d) AS first_d, max(d) AS last_d FROM trades GROUP BY mint) SELECT a.*, intervals, covered_days, last_d - first_d + 1 - covered_days AS gap_days FROM a JOIN v ON v.mint = a.mint",
    "WITH s AS (SELECT DISTINCT mint, d FROM trades), g AS (SELECT mint, d, lead(d) OVER (PARTITION BY mint ORDER BY d) - d AS gap FROM s), v AS (SELECT mint, 1 + count(*) FILTER (WHERE gap > 30) AS intervals, CAST(max(d) - min(d) + 1 - coalesce(sum(CASE WHEN gap > 30 THEN gap - 1 END), 0) AS BIGINT) AS covered_days FROM g GROUP BY mint) SELECT a.mint, count(*) AS n, CAST(sum(delta) AS BIGINT) AS flow, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT d) AS active_days, min(d) AS first_d, max(d) AS last_d, max(intervals) AS intervals, max(covered_days) AS covered_days, max(d) - min(d) + 1 - max(covered_days) AS gap_days FROM trades a JOIN v ON v.mint = a.mint GROUP BY a.mint",
)

# Sales of a wallet in one coin no more than 120 days apart are an episode; slices of much the same size, none above half of all, make it an iceberg. Resilience: the price after the episode over that before its first slice.
statement(
    "iceberg_candidates",
    f"""WITH s AS (SELECT owner, mint, d, slot, txi, qty, px, CASE WHEN d - lag(d) OVER w <= 120 THEN 0 ELSE 1 END AS opens FROM trades WHERE side = -1 WINDOW w AS (PARTITION BY owner, mint ORDER BY d, slot, txi, cents)),
 e AS (SELECT *, sum(opens) OVER (PARTITION BY owner, mint ORDER BY d, slot, txi {_SO_FAR}) AS episode FROM s),
 g AS (SELECT owner, mint, episode, count(*) AS slices, CAST(sum(qty) AS BIGINT) AS sold, max(qty) AS largest, min(d) AS first_d, max(d) AS last_d, {q('stddev_pop(CAST(qty AS DOUBLE)) / avg(CAST(qty AS DOUBLE))', 6)} AS spread, {q('max_by(px, struct(d, slot, txi, qty)) / min_by(px, struct(d, slot, txi, qty))', 6)} AS resilience FROM e GROUP BY owner, mint, episode)
SELECT owner, mint, CAST(episode AS BIGINT) AS episode, slices, sold, largest, first_d, last_d, spread, resilience FROM g WHERE slices >= 2 AND largest * 2 <= sold""",
)

# Cells by exact quartiles of a mint's volume and of its owners, counted before day 1200; a cell's rate is shrunk to that of all.
statement(
    "cell_model",
    """WITH m AS (SELECT mint, CAST(sum(qty) AS DOUBLE) AS v, CAST(count(DISTINCT owner) AS DOUBLE) AS o, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM trades WHERE d < 1200 GROUP BY mint),
 e AS (SELECT percentile(v, 0.25) AS v1, percentile(v, 0.5) AS v2, percentile(v, 0.75) AS v3, percentile(o, 0.25) AS o1, percentile(o, 0.5) AS o2, percentile(o, 0.75) AS o3, sum(k) / sum(n) AS p FROM m),
 c AS (SELECT CASE WHEN v <= v1 THEN 1 WHEN v <= v2 THEN 2 WHEN v <= v3 THEN 3 ELSE 4 END AS volume_quartile, CASE WHEN o <= o1 THEN 1 WHEN o <= o2 THEN 2 WHEN o <= o3 THEN 3 ELSE 4 END AS owner_quartile, k, n, p FROM m, e)
SELECT volume_quartile, owner_quartile, count(*) AS mints, (sum(k) + 20 * max(p)) / (sum(n) + 20) AS shrunk FROM c GROUP BY volume_quartile, owner_quartile""",
)

# How far each birth comes: traded five times, twenty times, doubled, alive after a year; and whether the tape reaches far enough to tell.
statement(
    "birth_cohort",
    """WITH z AS (SELECT max(d) AS now_ FROM trades), b AS (SELECT mint, min(d) AS born, max(d) AS last_d, min_by(owner, struct(d, slot, txi, owner)) AS seed_owner, count(*) AS n, max(px) / min_by(px, struct(d, slot, txi, owner, cents)) AS best FROM trades GROUP BY mint)
SELECT mint, born, seed_owner, n >= 5 AS traded, n >= 20 AS curve_ok, n >= 20 AND best >= 2 AS doubled, n >= 20 AND best >= 2 AND last_d >= born + 365 AS alive_after_year, born + 365 <= now_ AS uncensored FROM b, z""",
)

# A coin has ripped on the day its price falls below a third of its peak; each wallet's ledger counts the coins it was in, and those it left in the 60 days before.
statement(
    "crime_ledger_build",
    f"""WITH p AS (SELECT mint, d, px, max(px) OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents {_SO_FAR}) AS peak FROM trades), r AS (SELECT mint, min(d) AS rip FROM p WHERE px < peak / 3 GROUP BY mint),
 w AS (SELECT owner, l.mint, min(d) AS came, max(CASE WHEN side = -1 AND d < rip THEN d END) AS left_, max(rip) AS rip FROM trades l LEFT JOIN r ON r.mint = l.mint GROUP BY owner, l.mint)
SELECT owner, count(*) AS coins, count(*) FILTER (WHERE came < rip) AS in_rips, count(*) FILTER (WHERE came < rip AND left_ >= rip - 60) AS dumps FROM w GROUP BY owner HAVING count(*) >= 2""",
)

# A call's features as known at it, by a running window over trades and calls, and its label's state.
_SET = "CASE WHEN t < 86400 * 1200 THEN 'train' WHEN t < 86400 * 1260 THEN 'excluded_embargo' ELSE 'validation' END"
statement(
    "dataset_materialize",
    f"""WITH z AS (SELECT max(t) AS now_ FROM trades), b AS (SELECT mint, t, 0 AS o, delta, px, CAST(NULL AS BIGINT) AS call_id, slot, txi, owner, cents FROM trades UNION ALL SELECT mint, t, 1, 0, NULL, call_id, NULL, NULL, NULL, NULL FROM calls),
 f AS (SELECT call_id, mint, t, o, count(px) OVER w AS known, CAST(sum(delta) OVER w AS BIGINT) AS flow, last_value(px) IGNORE NULLS OVER w AS px FROM b WINDOW w AS (PARTITION BY mint ORDER BY t, o, slot, txi, owner, cents {_SO_FAR}))
SELECT call_id, mint, known, flow, px, CASE WHEN known = 0 THEN 'no_history' WHEN t + 86400 * 90 > now_ THEN 'censored' ELSE 'labelled' END AS label_state, {_SET} AS part FROM f, z WHERE o = 1""",
    f"""WITH z AS (SELECT max(t) AS now_ FROM trades), f AS (SELECT c.call_id, c.mint, c.t, count(l.mint) AS known, CAST(coalesce(sum(l.delta), 0) AS BIGINT) AS flow, max_by(l.px, row(l.t, l.slot, l.txi, l.owner, l.cents)) AS px FROM calls c LEFT JOIN trades l ON l.mint = c.mint AND l.t <= c.t GROUP BY c.call_id, c.mint, c.t)
SELECT call_id, mint, known, flow, px, CASE WHEN known = 0 THEN 'no_history' WHEN t + 86400 * 90 > now_ THEN 'censored' ELSE 'labelled' END AS label_state, {_SET} AS part FROM f, z""",
)

# Squared steps of lag 1 and lag 4 within each half of a mint's events (a pair counts only if both ends lie in one half), and their ratio a step.
_HALVES = "e AS (SELECT mint, px, row_number() OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents) AS rn, count(*) OVER (PARTITION BY mint) AS n FROM trades), h AS (SELECT mint, rn, ln(px) AS l, CASE WHEN rn * 2 <= n THEN 1 ELSE 2 END AS half FROM e)"
statement(
    "moving_block_halves",
    f"WITH {_HALVES}, s AS (SELECT mint, half, l - lag(l, 1) OVER w AS a, l - lag(l, 4) OVER w AS b FROM h WINDOW w AS (PARTITION BY mint, half ORDER BY rn)) SELECT mint, half, {q('sum(a * a) / nullif(count(a), 0)', 6)} AS lag1, {q('sum(b * b) / nullif(count(b), 0)', 6)} AS lag4, {q('(sum(b * b) / count(b) / 4) / nullif(sum(a * a) / count(a), 0)', 6)} AS slope FROM s GROUP BY mint, half HAVING count(b) > 0",
    f"WITH {_HALVES}, p AS (SELECT x.mint, x.half, y.rn - x.rn AS lag_, (y.l - x.l) * (y.l - x.l) AS s FROM h x JOIN h y ON y.mint = x.mint AND y.half = x.half AND y.rn - x.rn IN (1, 4)) SELECT mint, half, {q('avg(CASE WHEN lag_ = 1 THEN s END)', 6)} AS lag1, {q('avg(CASE WHEN lag_ = 4 THEN s END)', 6)} AS lag4, {q('avg(CASE WHEN lag_ = 4 THEN s END) / 4 / nullif(avg(CASE WHEN lag_ = 1 THEN s END), 0)', 6)} AS slope FROM p GROUP BY mint, half HAVING count(CASE WHEN lag_ = 4 THEN 1 END) > 0",
)
