"""Windows, order and limits, survival curves and other running statistics."""

from tidemark.operators.sql import q, statement

_ORDER = "d, slot, txi, owner, cents"
statement("row_number_topn", "SELECT mint, owner, n FROM (SELECT mint, owner, count(*) AS n, row_number() OVER (PARTITION BY mint ORDER BY count(*) DESC, owner) AS rk FROM trades GROUP BY mint, owner) x WHERE rk = 1")
statement("row_number_sequence", f"SELECT mint, slot, txi, owner, cents, CAST(row_number() OVER (PARTITION BY mint ORDER BY {_ORDER}) AS BIGINT) AS rn FROM trades")
statement("rank_ties", "SELECT mint, CAST(rank() OVER (ORDER BY v) AS BIGINT) AS r FROM (SELECT mint, CAST(sum(qty) AS BIGINT) AS v FROM trades GROUP BY mint) x")
statement("lag_lead", f"SELECT mint, slot, txi, owner, cents, lag(px) OVER (PARTITION BY mint ORDER BY {_ORDER}) AS before, (lead(px, 8) OVER (PARTITION BY mint ORDER BY {_ORDER})) - px AS e8 FROM trades")
statement("gap_detect_lead", "SELECT mint, d, nxt FROM (SELECT mint, d, lead(d) OVER (PARTITION BY mint ORDER BY d) AS nxt FROM (SELECT DISTINCT mint, d FROM trades) y) x WHERE nxt - d > 3")
statement("running_sum", f"SELECT owner, mint, slot, txi, cents, CAST(sum(delta) OVER (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS after FROM trades")
statement("running_max_drawdown", f"SELECT mint, max(m - px) AS drawdown FROM (SELECT mint, px, max(px) OVER (PARTITION BY mint ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM trades) x GROUP BY mint")
statement("suffix_max", f"SELECT mint, slot, txi, owner, cents, max(px) OVER (PARTITION BY mint ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sufmax FROM trades")
_EPISODE = "f AS (SELECT owner, mint, d, slot, txi, cents, delta, sum(delta) OVER w AS after FROM trades WINDOW w AS (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), o AS (SELECT *, CASE WHEN after - delta <= 0 AND after > 0 THEN 1 ELSE 0 END AS opens FROM f)"
statement("episode_sessionize", f"WITH {_EPISODE} SELECT owner, slot, txi, mint, cents, CAST(sum(opens) OVER (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode FROM o")
statement("episode_observe_inventory", f"WITH {_EPISODE}, e AS (SELECT owner, d, delta, sum(opens) OVER (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM o) SELECT owner, CAST(episode AS BIGINT) AS episode, min(d) AS opened, max(d) AS last, CAST(sum(delta) AS BIGINT) AS inventory FROM e GROUP BY owner, episode")
statement("named_window", f"SELECT mint, slot, txi, owner, cents, max(px) OVER w AS m FROM trades WINDOW w AS (PARTITION BY mint ORDER BY {_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
_E = f"e AS (SELECT mint, px, row_number() OVER (PARTITION BY mint ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY mint) AS n FROM trades)"
statement("tumbling_event_windows", f"WITH {_E} SELECT mint, CAST((rn - 1) div 8 AS BIGINT) AS w, min(px) AS low, max(px) AS high FROM e GROUP BY 1, 2 HAVING count(*) = 8")
statement("conservative_silence_hazard", "WITH g AS (SELECT mint, lead(d) OVER (PARTITION BY mint ORDER BY d) - d AS gap FROM (SELECT DISTINCT mint, d FROM trades) x) SELECT silence, count(*) FILTER (WHERE gap > silence OR gap IS NULL) AS silent, count(*) FILTER (WHERE gap > silence) AS came_back FROM g, (VALUES (10), (30), (90), (180)) AS s(silence) GROUP BY silence")
statement("survival_curve_censored", "WITH l AS (SELECT mint, max(d) - min(d) AS age, 2600 - min(d) AS span FROM trades GROUP BY mint) SELECT a, count(*) FILTER (WHERE span >= a) AS denominator, count(*) FILTER (WHERE span >= a AND age >= a) AS alive FROM l, (VALUES (100), (500), (1000), (2000), (2400)) AS ages(a) GROUP BY a")
statement("order_by_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
statement("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 2")
statement("rank_cards", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS BIGINT) AS card FROM orders ORDER BY card LIMIT 100")
statement("leaderboard", f"SELECT caller, n, mid FROM (SELECT caller, count(*) AS n, {q('median(price)')} AS mid FROM calls GROUP BY caller HAVING count(*) >= 5) x ORDER BY mid DESC, caller LIMIT 20")
statement("candidate_ranking", "SELECT mint, n, top FROM (SELECT mint, count(*) AS n, max(px) AS top FROM trades WHERE side = 1 GROUP BY mint) x ORDER BY n DESC, top DESC, mint LIMIT 40")
statement("qualify_top_per_group", "SELECT mint, owner, n FROM (SELECT mint, owner, count(DISTINCT slot) AS n, row_number() OVER (PARTITION BY mint ORDER BY count(DISTINCT slot) DESC, owner) AS rk FROM trades GROUP BY mint, owner HAVING count(*) >= 1) x WHERE rk <= 3")
statement("hash_order_sample", "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR(20))), c_custkey LIMIT 50")
_AJ = "r AS (SELECT o_custkey % 200 + 1 AS time_to, CASE o_orderstatus WHEN 'F' THEN 'died' WHEN 'P' THEN 'moved' END AS mode FROM orders), c AS (SELECT time_to, count(*) AS n, count(mode) AS d, count(*) FILTER (WHERE mode = 'died') AS d1 FROM r GROUP BY time_to), k AS (SELECT time_to, d, d1, sum(n) OVER (ORDER BY time_to DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM c), s AS (SELECT time_to, d1, at_risk, exp(sum(ln(CASE WHEN d < at_risk THEN 1 - CAST(d AS DOUBLE) / at_risk ELSE 1e-300 END)) OVER (ORDER BY time_to ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS surv FROM k), b AS (SELECT time_to, surv, CAST(d1 AS DOUBLE) / at_risk * lag(surv, 1, CAST(1 AS DOUBLE)) OVER (ORDER BY time_to) AS step FROM s)"
_AJ_OUT = f"WITH {_AJ} SELECT time_to, {q('surv', 8)} AS surv, {q('sum(step) OVER (ORDER BY time_to ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 8)} AS cif FROM b"
statement("kaplan_aalen_johansen", _AJ_OUT)
statement("one_minus_km", f"WITH {_AJ} SELECT time_to, " + q("1 - exp(sum(ln(CASE WHEN d1 < at_risk THEN 1 - CAST(d1 AS DOUBLE) / at_risk ELSE 1e-300 END)) OVER (ORDER BY time_to ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", 8) + " AS cif FROM k")
statement("circular_shift_null", f"WITH s AS (SELECT d, CAST(sum(delta) AS DOUBLE) AS x, row_number() OVER (ORDER BY d) - 1 AS rn, count(*) OVER () AS n FROM trades GROUP BY d), k AS (SELECT explode(sequence(CAST(1 AS BIGINT), n - 1)) AS shift FROM (SELECT max(n) AS n FROM s) z WHERE n > 1) SELECT CAST(shift AS BIGINT) AS shift, {q('corr(a.x, b.x)', 6)} AS r FROM s a CROSS JOIN k JOIN s b ON b.rn = (a.rn + shift) % a.n GROUP BY shift")
_CUM = "z AS (SELECT owner, d, slot, txi, mint, cents, (CAST(delta AS DOUBLE) - 10) / 16 AS z FROM trades), h AS (SELECT *, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS down FROM z WINDOW w AS (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), m AS (SELECT *, up - least(0, min(up) OVER w) AS hi, down - least(0, min(down) OVER w) AS lo FROM h WINDOW w AS (PARTITION BY owner ORDER BY d, slot, txi, mint, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
statement("cusum", f"WITH {_CUM} SELECT owner, {q('max(greatest(hi, lo))', 6)} AS cusum FROM m GROUP BY owner")
statement("lomb_scargle", f"WITH s AS (SELECT CAST(d AS DOUBLE) AS x, CAST(sum(delta) AS DOUBLE) AS y FROM trades GROUP BY d), m AS (SELECT avg(y) AS my, var_samp(y) AS v FROM s), p AS (SELECT f, x, y - my AS y, v FROM s, m, (VALUES (7.0), (30.0), (91.0), (365.0)) AS fs(f)), k AS (SELECT f, atan2(sum(sin(2 * 2 * pi() * x / f)), sum(cos(2 * 2 * pi() * x / f))) / 2 AS tau FROM p GROUP BY f), g AS (SELECT p.f, sum(y * cos(2 * pi() * x / p.f - tau)) AS c, sum(y * sin(2 * pi() * x / p.f - tau)) AS s, sum(cos(2 * pi() * x / p.f - tau) * cos(2 * pi() * x / p.f - tau)) AS cc, sum(sin(2 * pi() * x / p.f - tau) * sin(2 * pi() * x / p.f - tau)) AS ss, max(v) AS v FROM p JOIN k ON p.f = k.f GROUP BY p.f) SELECT CAST(f AS DOUBLE) AS period, {q('(c * c / cc + s * s / ss) / (2 * v)', 5)} AS power FROM g")
statement("floor_clearing_labels", f"SELECT mint, slot, txi, owner, cents, CASE WHEN later IS NULL THEN NULL WHEN best >= entry * 1.02 THEN 1 ELSE 0 END AS label FROM (SELECT mint, slot, txi, owner, cents, lead(px, 1) OVER w AS entry, lead(px, 6) OVER w AS later, max(px) OVER (PARTITION BY mint ORDER BY {_ORDER} ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS best FROM trades WINDOW w AS (PARTITION BY mint ORDER BY {_ORDER})) x")
statement("signature_volatility_event", f"WITH {_E}, w AS (SELECT a.mint, lag_, avg((b.px - a.px) * (b.px - a.px)) AS v FROM e a JOIN (VALUES (1), (2), (4)) AS lags(lag_) ON true JOIN e b ON b.mint = a.mint AND b.rn = a.rn + lag_ GROUP BY a.mint, lag_), m AS (SELECT mint, avg(px) AS p FROM trades GROUP BY mint) SELECT w.mint, lag_, {q('v / (lag_ * p * p)', 8)} AS sigma2 FROM w JOIN m ON w.mint = m.mint")
statement("signature_volatility_wall", f"WITH g AS (SELECT mint, t, max(px) AS px FROM trades GROUP BY mint, t), m AS (SELECT mint, avg(px) AS p FROM g GROUP BY mint) SELECT a.mint, {q('avg((b.px - a.px) * (b.px - a.px)) / (100 * max(p) * max(p))', 8)} AS sigma2 FROM g a JOIN g b ON a.mint = b.mint AND b.t - a.t BETWEEN 86400 * 90 AND 86400 * 110 JOIN m ON m.mint = a.mint GROUP BY a.mint")
statement("sigma2_from_path", f"WITH g AS (SELECT mint, d, ln(px) - lag(ln(px)) OVER (PARTITION BY mint ORDER BY {_ORDER}) AS r FROM trades) SELECT mint, {q('sum(r * r) / nullif(max(d) - min(d), 0)', 8)} AS sigma2_day FROM g GROUP BY mint")
statement("caller_track_record", f"SELECT call_id, count(*) OVER w AS resolved, max(price) OVER w AS best FROM calls WINDOW w AS (PARTITION BY caller ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2592000 PRECEDING)")
statement("first_bursts", "SELECT mint, min(d) + 1 AS at FROM (SELECT mint, d div 30 * 30 AS d, count(DISTINCT owner) AS n FROM trades WHERE side = 1 GROUP BY 1, 2) x WHERE n >= 2 GROUP BY mint")
statement("burst_statistic", f"SELECT a.mint, {q('avg(CAST(n AS DOUBLE))', 6)} AS burst FROM (SELECT a.mint, a.slot, a.txi, a.owner, a.cents, count(DISTINCT b.owner) AS n FROM trades a JOIN trades b ON a.mint = b.mint AND abs(a.d - b.d) <= 20 AND a.owner <> b.owner GROUP BY a.mint, a.slot, a.txi, a.owner, a.cents) a GROUP BY a.mint")
statement("wallet_legs_summary", "SELECT c.call_id, l.owner, min(CASE WHEN side = 1 THEN l.t END) AS first_buy, max(CASE WHEN side = 1 AND l.t < c.t THEN l.t END) AS last_buy_before, CAST(sum(CASE WHEN side = -1 AND l.t >= c.t THEN qty ELSE 0 END) AS BIGINT) AS sold_after FROM calls c JOIN trades l ON l.mint = c.mint GROUP BY c.call_id, l.owner")
statement("onchain_features_at_call", "SELECT c.call_id, count(*) AS n, count(DISTINCT l.owner) AS owners, CAST(sum(delta) AS BIGINT) AS flow, max(px) AS top FROM calls c JOIN trades l ON l.mint = c.mint AND l.t < c.t GROUP BY c.call_id")
statement("callout_peak_multiple", "SELECT c.call_id, greatest(1.0D, max(l.px) / min_by(l.px, struct(l.t, l.slot, l.txi, l.owner, l.cents))) AS multiple FROM calls c JOIN trades l ON l.mint = c.mint AND l.t >= c.t GROUP BY c.call_id", "SELECT c.call_id, greatest(CAST(1 AS DOUBLE), max(l.px) / min_by(l.px, row(l.t, l.slot, l.txi, l.owner, l.cents))) AS multiple FROM calls c JOIN trades l ON l.mint = c.mint AND l.t >= c.t GROUP BY c.call_id")
statement("entry_window_measure", "SELECT c.call_id, count(*) AS n, min_by(l.px, struct(l.t, l.slot, l.txi, l.owner, l.cents)) AS first, max(l.px) AS high, min(l.px) AS low FROM calls c JOIN trades l ON l.mint = c.mint AND l.t >= c.t AND l.t < c.t + 86400 * 60 GROUP BY c.call_id")
statement("buy_call_sell_choreography", "SELECT call_id, CASE WHEN bought > 0 AND sold > 0 THEN 'buy_call_sell' WHEN bought > 0 THEN 'buy_call' WHEN sold > 0 THEN 'call_sell' ELSE 'none' END AS shape FROM (SELECT c.call_id, count(*) FILTER (WHERE side = 1 AND l.t < c.t) AS bought, count(*) FILTER (WHERE side = -1 AND l.t > c.t) AS sold FROM calls c JOIN trades l ON l.mint = c.mint AND l.t BETWEEN c.t - 86400 * 40 AND c.t + 86400 * 40 GROUP BY c.call_id) x")
statement("both_edges_touch", "SELECT CAST(w AS DOUBLE) AS w, count(*) AS n, count(*) FILTER (WHERE hi >= px + w AND lo <= px - w) AS both_edges FROM (SELECT a.mint, a.px, max(b.px) AS hi, min(b.px) AS lo FROM (SELECT mint, d, max(px) AS px FROM trades GROUP BY mint, d) a JOIN trades b ON b.mint = a.mint AND b.d > a.d AND b.d <= a.d + 120 GROUP BY a.mint, a.d, a.px) x, (VALUES (0.0), (0.05), (0.5)) AS ws(w) GROUP BY w")
statement("window_twap", "SELECT mint, d div 100 AS w, CASE WHEN count(*) >= 2 THEN max(c) END AS high, CASE WHEN count(*) >= 2 THEN CAST(sum(c) AS DOUBLE) / count(*) END AS twap FROM (SELECT mint, d, CAST(floor(max_by(px, struct(slot, txi, owner, cents)) * 100 + 0.25) AS BIGINT) AS c FROM trades GROUP BY mint, d) x GROUP BY 1, 2")
statement("step_series", f"WITH s AS (SELECT mint, d, max(px) AS px FROM trades GROUP BY mint, d), g AS (SELECT mint, px, lead(d) OVER (PARTITION BY mint ORDER BY d) - d AS held FROM s) SELECT mint, {q('sum(px * held) / nullif(sum(held), 0)', 3)} AS twap FROM g GROUP BY mint")
statement("prediction_base_rates", "WITH c AS (SELECT d, max_by(px, struct(slot, txi, mint, owner, cents)) AS c FROM trades GROUP BY d), b AS (SELECT min(d) AS lo, max(d) AS hi FROM c), g AS (SELECT explode(sequence(lo, hi, 5)) AS d FROM b) SELECT CAST(h AS BIGINT) AS horizon, count(*) AS n, count(*) FILTER (WHERE y.c > x.c) AS up FROM g JOIN c x ON x.d = g.d CROSS JOIN (VALUES (5), (20)) AS hs(h) JOIN c y ON y.d = g.d + h GROUP BY h")
statement("block_excursion_census", "WITH a AS (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint) SELECT l.mint, (l.d - d0) div 200 AS block, count(*) AS n, max(px) / min(px) - 1 AS excursion FROM trades l JOIN a ON a.mint = l.mint GROUP BY 1, 2")
statement("excursion_summary", "WITH a AS (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint), b AS (SELECT l.mint, (l.d - d0) div 200 AS block, count(*) AS n, max(px) / min(px) - 1 AS excursion FROM trades l JOIN a ON a.mint = l.mint GROUP BY 1, 2) SELECT count(*) AS blocks, count(*) FILTER (WHERE n >= 3) AS workable, count(*) FILTER (WHERE n >= 3 AND excursion >= 0.05) AS qualifying FROM b")
statement("digest_window", f"SELECT t div 3600 * 3600 AS hour, count(*) AS n, max(value) AS top FROM ev GROUP BY 1")
statement("tumbling_minute", "SELECT t div 60 * 60 AS minute, count(*) AS n FROM ev GROUP BY 1")
statement("board_watcher", "WITH s AS (SELECT DISTINCT d div 100 AS snap, mint FROM trades), p AS (SELECT snap, mint, lag(snap) OVER (PARTITION BY mint ORDER BY snap) AS before, lead(snap) OVER (PARTITION BY mint ORDER BY snap) AS next_ FROM s) SELECT mint, snap, before IS NULL OR before < snap - 1 AS enters, next_ IS NULL OR next_ > snap + 1 AS leaves FROM p")
statement("rug_detection", f"SELECT mint, slot, txi, owner, cents, px < 0.7 * high AS drop_, px < 0.7 * high AND before < 0.7 * high AS confirmed FROM (SELECT mint, slot, txi, owner, cents, px, max(px) OVER w AS high, lag(px) OVER (PARTITION BY mint ORDER BY {_ORDER}) AS before FROM trades WINDOW w AS (PARTITION BY mint ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x")
statement("early_flow_features", f"WITH b AS (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint) SELECT l.mint, count(*) AS n, CAST(sum(delta) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS imbalance, count(DISTINCT owner) AS owners FROM trades l JOIN b ON b.mint = l.mint AND l.d < d0 + 300 GROUP BY l.mint")
statement("early_coin_features", f"WITH b AS (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint) SELECT l.mint, count(*) FILTER (WHERE side = 1) AS buys, count(*) FILTER (WHERE side = -1) AS sells, max(qty) AS largest, min(px) AS low, max(px) AS high FROM trades l JOIN b ON b.mint = l.mint AND l.d < d0 + 120 GROUP BY l.mint")
statement("candle_features", f"WITH c AS (SELECT mint, d, max_by(px, struct(slot, txi, owner, cents)) AS c FROM trades GROUP BY mint, d), g AS (SELECT mint, c, c - lag(c) OVER (PARTITION BY mint ORDER BY d) AS move FROM c) SELECT mint, count(*) AS bars, count(*) FILTER (WHERE move > 0) AS up, {q('coalesce(stddev_samp(move), 0)', 6)} AS vol FROM g GROUP BY mint")
statement("birth_aligned_events", "WITH b AS (SELECT mint, min(t) AS t0 FROM trades GROUP BY mint) SELECT l.mint, l.slot, l.txi, l.owner, l.cents, l.t - t0 AS dt FROM trades l JOIN b ON b.mint = l.mint")
statement("mint_meta", "SELECT mint, min(d) AS first_d, max(d) AS last_d, count(*) AS n, min(d) <= 5 AS left_censored, max(d) >= 2500 AS right_censored FROM trades GROUP BY mint")
statement("omori_decay", f"WITH b AS (SELECT mint, min(d) AS d0 FROM trades GROUP BY mint), a AS (SELECT lo, hi, count(*) AS n FROM trades l JOIN b ON b.mint = l.mint JOIN (VALUES (1, 30), (30, 90), (90, 270), (270, 810), (810, 2430)) AS k(lo, hi) ON l.d - d0 >= lo AND l.d - d0 < hi GROUP BY lo, hi) SELECT {q('regr_slope(ln(CAST(n AS DOUBLE) / (hi - lo)), ln((hi + lo) / CAST(2 AS DOUBLE)))', 6)} AS slope FROM a")
statement("temporal_partition", "SELECT call_id, CASE WHEN t < 86400 * 1200 THEN 'train' WHEN t < 86400 * 1260 THEN 'excluded_embargo' ELSE 'validation' END AS partition_ FROM calls")
statement("leakage_assert", "WITH s AS (SELECT mint, t, CASE WHEN t < 86400 * 1200 THEN 'train' ELSE 'test' END AS part FROM calls) SELECT count(*) AS violations FROM (SELECT mint FROM s WHERE part = 'train' AND t + 86400 * 30 >= 86400 * 1200) x")
statement("entity_temporal_split", "SELECT mint, CASE WHEN min(t) < 86400 * 900 THEN 'train' ELSE 'test' END AS side_ FROM calls GROUP BY mint")
statement("late_data_policy", "SELECT slot, txi, owner, d AS event_d, d + txi * 5 AS known_d, txi * 5 > 20 AS late FROM trades WHERE d + txi * 5 <= 1500")
statement("resolve_cashtag", "SELECT concat(p_brand, '-', p_type, '-', p_size) AS tag, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS part, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part GROUP BY p_brand, p_type, p_size")
statement("selection_outcomes", "SELECT c.call_id, min_by(l.px, struct(l.t, l.slot, l.txi, l.owner, l.cents)) AS px FROM calls c JOIN trades l ON l.mint = c.mint AND l.t >= c.t + 86400 * 5 GROUP BY c.call_id")
_TWO = "SELECT DISTINCT x.mint AS a, x.owner AS b, CAST(NULL AS BIGINT) AS c FROM trades x JOIN trades y ON y.mint = x.owner AND y.owner = x.mint WHERE x.mint < x.owner"
statement("circuit_cycles", f"""WITH p AS (SELECT DISTINCT mint, owner FROM trades WHERE mint <> owner), e AS (SELECT DISTINCT least(mint, owner) AS a, greatest(mint, owner) AS b FROM p),
 n AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) u GROUP BY v),
 o AS (SELECT CASE WHEN x.degree <= y.degree THEN a ELSE b END AS low, CASE WHEN x.degree <= y.degree THEN b ELSE a END AS high FROM e JOIN n x ON x.v = a JOIN n y ON y.v = b),
 w AS (SELECT x.low AS u, x.high AS v, y.high AS w FROM o x JOIN o y ON x.low = y.low AND x.high < y.high)
SELECT least(u, v, w) AS a, u + v + w - least(u, v, w) - greatest(u, v, w) AS b, greatest(u, v, w) AS c FROM w JOIN e ON e.a = v AND e.b = w.w
UNION ALL {_TWO.replace("trades", "p")}""", f"WITH e AS (SELECT DISTINCT least(mint, owner) AS a, greatest(mint, owner) AS b FROM trades WHERE mint <> owner) SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b UNION ALL {_TWO}")
statement("activity_feasibility", "WITH b AS (SELECT CAST(count(DISTINCT mint) AS BIGINT) AS tokens FROM trades), g AS (SELECT explode(sequence(1, 2000)) AS n FROM b) SELECT max(CAST(n AS BIGINT)) AS feasible FROM g, b WHERE CAST(n AS BIGINT) * (n - 1) * 20 * 50 <= 2 * tokens * (tokens - 1) div 2")
