"""Aggregations, ranks and the statistics that are plain aggregates."""

from tidemark.operators.sql import exact, q, statement

statement("group_by_multi_agg", f"SELECT mint, owner, count(*) AS n, CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(delta) AS BIGINT) AS flow, min(px) AS low, max(px) AS high, {exact('cents / 100.0')} AS spend FROM trades GROUP BY mint, owner")
statement("filtered_aggregate", "SELECT mint, count(*) FILTER (WHERE side = 1) AS n_buys, count(*) FILTER (WHERE side = -1) AS n_sells, CAST(sum(qty) FILTER (WHERE side = 1) AS BIGINT) AS bought FROM trades GROUP BY mint")
statement("arg_min_max", "SELECT mint, min_by(px, struct(d, slot, txi, owner, cents)) AS open, max_by(px, struct(d, slot, txi, owner, cents)) AS close FROM trades GROUP BY mint")
statement("ordered_last_first", "SELECT owner, max_by(qty, struct(t, slot, txi, mint, cents, qty)) AS final, min_by(qty, struct(t, slot, txi, mint, cents, qty)) AS opening FROM trades GROUP BY owner")
statement("count_distinct", "SELECT day, count(DISTINCT mint) AS mints, count(DISTINCT owner) AS owners FROM trades GROUP BY day")
statement("count_distinct_conditional", "SELECT day, count(DISTINCT CASE WHEN side = 1 THEN mint END) AS bought_mints FROM trades GROUP BY day")
statement("quantile_exact", f"SELECT status, {q('percentile(px, 0.25)')} AS p25, {q('percentile(px, 0.5)')} AS p50, {q('percentile(px, 0.95)')} AS p95 FROM trades GROUP BY status")
statement("median", f"SELECT mint, {q('median(px)')} AS mid, {q('median(px) FILTER (WHERE side = 1)')} AS buy_mid FROM trades GROUP BY mint")
statement("mode_deterministic", "SELECT mint, owner FROM (SELECT mint, owner, row_number() OVER (PARTITION BY mint ORDER BY count(*) DESC, owner) AS rn FROM trades GROUP BY mint, owner) x WHERE rn = 1")
statement("regression_slope_r2", f"SELECT status, {q('regr_slope(ln(px), ln(qty))')} AS slope, {q('regr_r2(ln(px), ln(qty))')} AS r2 FROM trades GROUP BY status")
statement("correlation", f"SELECT status, {q('corr(px, CAST(qty AS DOUBLE))')} AS r FROM trades GROUP BY status")
statement("stddev_sample", f"SELECT mint, {q('coalesce(stddev_samp(px), 0)')} AS vol FROM trades GROUP BY mint")
statement("distinct", "SELECT DISTINCT mint, owner FROM trades")
statement("having", "SELECT mint, count(*) AS n FROM trades GROUP BY mint HAVING count(*) >= 35")
statement("share_of_total", "SELECT owner, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM trades GROUP BY owner")
statement("window_over_aggregate", "SELECT mint, d, CAST(sum(sum(delta)) OVER (PARTITION BY mint ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS inventory FROM trades GROUP BY mint, d")
statement("hhi_top_share", "SELECT mint, CAST(sum(g * g) AS DOUBLE) / nullif(CAST(sum(g) AS DOUBLE) * CAST(sum(g) AS DOUBLE), 0) AS hhi, CAST(max(g) AS DOUBLE) / nullif(CAST(sum(g) AS DOUBLE), 0) AS top FROM (SELECT mint, owner, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP BY mint, owner) x GROUP BY mint")
statement("gini", "SELECT mint, CAST(2 * sum(rn * g) AS DOUBLE) / (count(*) * CAST(sum(g) AS DOUBLE)) - CAST(count(*) + 1 AS DOUBLE) / count(*) AS gini FROM (SELECT mint, g, row_number() OVER (PARTITION BY mint ORDER BY g) AS rn FROM (SELECT mint, owner, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP BY mint, owner) x WHERE g > 0) y GROUP BY mint")
statement("hhi", "SELECT owner, CAST(sum(g * g) AS DOUBLE) / (CAST(sum(g) AS DOUBLE) * CAST(sum(g) AS DOUBLE)) AS hhi FROM (SELECT owner, mint, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP BY owner, mint) x WHERE g > 0 GROUP BY owner")
statement("nakamoto", "SELECT mint, CAST(min(rn) AS BIGINT) AS nakamoto FROM (SELECT mint, row_number() OVER (PARTITION BY mint ORDER BY g DESC, owner) AS rn, sum(g) OVER (PARTITION BY mint ORDER BY g DESC, owner ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(g) OVER (PARTITION BY mint) AS total FROM (SELECT mint, owner, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP BY mint, owner) x WHERE g > 0) y WHERE cum * 2 >= total GROUP BY mint")
_CONCENTRATION = "SELECT mint, count(*) AS holders, CAST(max(g) AS DOUBLE) / CAST(sum(g) AS DOUBLE) AS top1, CAST(sum(CASE WHEN rn <= 10 THEN g END) AS DOUBLE) / CAST(sum(g) AS DOUBLE) AS top10, CAST(sum(g * g) AS DOUBLE) / (CAST(sum(g) AS DOUBLE) * CAST(sum(g) AS DOUBLE)) AS hhi, CAST(sum(g) AS DOUBLE) / count(*) AS mean FROM (SELECT mint, owner, g, row_number() OVER (PARTITION BY mint ORDER BY g DESC, owner) AS rn FROM (SELECT mint, owner, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP BY mint, owner) x WHERE g > 0) y GROUP BY mint"
statement("concentration_bundle", _CONCENTRATION)
statement("holder_features", _CONCENTRATION.replace("SELECT mint, owner, CAST(sum(qty) AS BIGINT) AS g FROM trades GROUP", "SELECT mint, owner, CAST(sum(delta) AS BIGINT) AS g FROM trades GROUP"))
statement("midrank", "SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / CAST(2 AS DOUBLE) AS midrank FROM documents")
_SCORED = "s AS (SELECT l.quality AS y, CAST(length(d.text) AS DOUBLE) AS score, l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id), r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS rk FROM s)"
statement("auc_rank", f"WITH {_SCORED} SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / nullif(CAST(sum(y) * (count(*) - sum(y)) AS DOUBLE), 0) AS auc FROM r")
_P = "p AS (SELECT l.quality AS y, CAST(least(length(d.text), 9999) AS DOUBLE) / 10000 AS p, l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
statement("brier", f"WITH {_P} SELECT {q('avg((y - p) * (y - p))', 8)} AS brier, count(*) AS n FROM p")
statement("calibration_bins", f"WITH {_P} SELECT CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n, {q('avg(p)', 8)} AS predicted, {q('avg(y)', 8)} AS observed FROM p GROUP BY 1")
statement("calibration_deciles", f"WITH {_P}, b AS (SELECT ntile(10) OVER (ORDER BY p, doc_id) AS decile, y, p FROM p) SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n, {q('avg(p)', 8)} AS predicted, {q('avg(y)', 8)} AS observed FROM b GROUP BY decile")
statement("ece_reliability", f"WITH {_P}, b AS (SELECT floor(p * 10) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM p GROUP BY 1) SELECT {q('sum(n * abs(mp - my)) / sum(n)', 8)} AS ece FROM b")
statement("log_loss_bits", f"WITH {_P} SELECT {q('avg(-(CASE WHEN y = 1 THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1 - p, 1e-6)) END) / ln(2))', 8)} AS bits FROM p")
statement("threshold_cells", f"WITH {_P} SELECT CAST(tau AS DOUBLE) AS tau, count(*) FILTER (WHERE p >= tau) AS fired, count(*) FILTER (WHERE p >= tau AND y = 1) AS hits FROM p, (VALUES (0.05), (0.2), (0.5), (0.9)) AS taus(tau) GROUP BY tau")
_WILSON = "(k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"
_WILSON_HI = _WILSON.replace("- 1.96", "+ 1.96")
statement("wilson_interval", f"SELECT source, {q(_WILSON, 9)} AS lo, {q(_WILSON_HI, 9)} AS hi FROM (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE lang = 'en') AS DOUBLE) AS k FROM documents GROUP BY source) x")
statement("rate_block", f"SELECT status, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, k / n AS rate, {q(_WILSON, 9)} AS lo FROM (SELECT status, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS k FROM trades GROUP BY status) x")
statement("stratum_screen", f"SELECT stratum, CAST(n AS BIGINT) AS n, k / n AS rate, {q(_WILSON, 9)} AS lo FROM (SELECT mint % 7 AS stratum, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE discount > 0.05) AS DOUBLE) AS k FROM trades GROUP BY 1) x")
_LABELS = "a AS (SELECT owner, CASE WHEN sum(delta) > 0 THEN 1 ELSE 0 END AS x FROM trades WHERE d < 1270 GROUP BY owner), b AS (SELECT owner, CASE WHEN sum(delta) > 0 THEN 1 ELSE 0 END AS y FROM trades WHERE d >= 1270 GROUP BY owner), j AS (SELECT CASE WHEN a.owner % 3 = 0 THEN 1 - x ELSE x END AS x, y FROM a JOIN b ON a.owner = b.owner), m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE x = y) AS DOUBLE) AS same, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy FROM j)"
statement("cohen_kappa_transition", f"WITH {_LABELS} SELECT same / n AS agreement, (same / n - (sx * sy + (n - sx) * (n - sy)) / (n * n)) / nullif(1 - (sx * sy + (n - sx) * (n - sy)) / (n * n), 0) AS kappa FROM m")
statement("spearman", f"WITH m AS (SELECT mint, CAST(sum(qty) AS BIGINT) AS a, max(px) AS b FROM trades GROUP BY mint), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / CAST(2 AS DOUBLE) AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / CAST(2 AS DOUBLE) AS rb FROM m) SELECT {q('corr(ra, rb)', 8)} AS rho FROM r")
statement("pearson_lead_lag", f"WITH s AS (SELECT d, CAST(sum(delta) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM trades GROUP BY d), l AS (SELECT x, y, lag(x, 1) OVER (ORDER BY d) AS x1, lag(x, 2) OVER (ORDER BY d) AS x2 FROM s) SELECT {q('corr(x, y)', 7)} AS lag0, {q('corr(x1, y)', 7)} AS lag1, {q('corr(x2, y)', 7)} AS lag2 FROM l")
_PV = "p AS (SELECT mint, exp(-CAST(abs(sum(delta)) AS DOUBLE) / 40) AS p FROM trades GROUP BY mint), r AS (SELECT mint, p, row_number() OVER (ORDER BY p, mint) AS rn, count(*) OVER () AS m FROM p)"
statement("benjamini_hochberg", f"WITH {_PV}, k AS (SELECT coalesce(max(rn), 0) AS k FROM r WHERE p <= 0.1 * rn / m) SELECT mint, rn <= k AS rejected FROM r, k")
_HARMONIC = "c AS (SELECT sum(CAST(1 AS DOUBLE) / rn) AS c FROM r)"
statement("benjamini_yekutieli", f"WITH {_PV}, {_HARMONIC}, k AS (SELECT coalesce(max(rn), 0) AS k FROM r, c WHERE p <= 0.1 * rn / (m * c)) SELECT mint, rn <= k AS rejected FROM r, k")
statement("operator_iceberg_fdr", f"WITH {_PV}, {_HARMONIC}, z AS (SELECT mint, rn, p * m * c / rn AS raw FROM r, c) SELECT mint, {q('least(min(raw) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)', 8)} AS q FROM z")
statement("mannwhitney_cliff", "WITH x AS (SELECT side, qty, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / CAST(2 AS DOUBLE) AS rk FROM trades), u AS (SELECT sum(CASE WHEN side = 1 THEN rk END) - CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) * (count(*) FILTER (WHERE side = 1) + 1) / 2 AS u, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE side = -1) AS DOUBLE) AS n2 FROM x) SELECT u, 2 * u / nullif(n1 * n2, 0) - 1 AS cliff FROM u")
statement("benford_first_digit", "SELECT CAST(substr(CAST(cents AS VARCHAR(20)), 1, 1) AS BIGINT) AS digit, count(*) AS n FROM trades WHERE cents > 0 GROUP BY 1")
statement("chao1_coverage", "WITH c AS (SELECT user_id, count(*) AS n FROM ev WHERE kind = 'signup' GROUP BY user_id) SELECT count(*) AS seen, count(*) + CAST(count(*) FILTER (WHERE n = 1) * (count(*) FILTER (WHERE n = 1) - 1) AS DOUBLE) / (2 * (count(*) FILTER (WHERE n = 2) + 1)) AS chao1 FROM c")
statement("kim_jo_burstiness", f"WITH g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev), m AS (SELECT user_id, CAST(count(gap) AS DOUBLE) AS n, stddev_pop(gap) / nullif(avg(gap), 0) AS r FROM g GROUP BY user_id) SELECT user_id, {q('(sqrt(n + 1) * r - sqrt(n - 1)) / nullif((sqrt(n + 1) - 2) * r + sqrt(n - 1), 0)', 6)} AS burstiness FROM m WHERE n >= 3")
statement("fano_branching", f"WITH c AS (SELECT user_id, t div 86400 AS day, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, {q('var_samp(n) / avg(n)', 6)} AS fano FROM c GROUP BY user_id HAVING count(*) >= 8")
statement("ar1", f"WITH s AS (SELECT d, CAST(sum(delta) AS DOUBLE) AS x FROM trades GROUP BY d), l AS (SELECT x, lag(x) OVER (ORDER BY d) AS b FROM s) SELECT {q('corr(x, b)', 6)} AS rho, {q('corr(x, b) + (1 + 3 * corr(x, b)) / count(*)', 6)} AS corrected FROM l")
statement("acf_lags", f"WITH s AS (SELECT d, CAST(sum(delta) AS DOUBLE) AS x FROM trades GROUP BY d), l AS (SELECT x, lag(x, 1) OVER (ORDER BY d) AS l1, lag(x, 2) OVER (ORDER BY d) AS l2, lag(x, 5) OVER (ORDER BY d) AS l5, lag(x, 10) OVER (ORDER BY d) AS l10 FROM s) SELECT {q('corr(x, l1)', 6)} AS acf1, {q('corr(x, l2)', 6)} AS acf2, {q('corr(x, l5)', 6)} AS acf5, {q('corr(x, l10)', 6)} AS acf10 FROM l")
statement("clustered_mean_se", f"WITH m AS (SELECT avg(CAST(qty AS DOUBLE)) AS mu, CAST(count(*) AS DOUBLE) AS n FROM trades), g AS (SELECT owner, sum(qty - mu) AS s FROM trades, m GROUP BY owner) SELECT {q('max(mu)', 6)} AS mean, {q('sqrt(sum(s * s) * count(*) / (count(*) - 1)) / max(n)', 6)} AS se FROM g, m")
statement("wallet_cluster_mean_se", f"SELECT mint, {q('avg(m)', 6)} AS mean, {q('stddev_samp(m) / sqrt(count(*))', 6)} AS se FROM (SELECT mint, owner, avg(CAST(qty AS DOUBLE)) AS m FROM trades GROUP BY mint, owner) x GROUP BY mint HAVING count(*) >= 2")
statement("raw_log_rate_pool", f"SELECT mint, {q('ln((2 * a + 1) / CAST(2 * b + 1 AS DOUBLE))', 7)} AS effect, CAST(2 AS DOUBLE) / (2 * a + 1) + CAST(2 AS DOUBLE) / (2 * b + 1) AS variance FROM (SELECT mint, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = -1) AS b FROM trades GROUP BY mint) x")
statement("poisson_pool", f"WITH x AS (SELECT mint, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) + 0.5 AS a, CAST(count(*) FILTER (WHERE side = -1) AS DOUBLE) + 0.5 AS b FROM trades GROUP BY mint), w AS (SELECT ln(a / b) AS e, 1 / (1 / a + 1 / b) AS w FROM x) SELECT {q('sum(w * e) / sum(w)', 6)} AS pooled, {q('1 / sqrt(sum(w))', 6)} AS se FROM w")
statement("distribution_summary", f"SELECT status, count(px) AS n, {q('percentile(px, 0.25)')} AS p25, {q('percentile(px, 0.5)')} AS p50, {q('percentile(px, 0.75)')} AS p75, count(*) - count(px) AS absent FROM trades GROUP BY status")
statement("verdict_histogram", "SELECT o_orderpriority AS verdict, count(*) AS n FROM orders GROUP BY o_orderpriority")
statement("cohort_wallet_mint", "SELECT owner, mint, CAST(sum(CASE WHEN side = 1 THEN qty ELSE 0 END) AS BIGINT) AS acquired, CAST(sum(CASE WHEN side = -1 THEN qty ELSE 0 END) AS BIGINT) AS disposed, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS swaps FROM trades GROUP BY owner, mint")
statement("cohort_aggregate", "SELECT mint, count(*) FILTER (WHERE bought > 0) AS buyers, count(*) FILTER (WHERE sold > 0) AS sellers, count(*) FILTER (WHERE bought > 0 AND sold > 0) AS both_sides FROM (SELECT mint, owner, count(*) FILTER (WHERE side = 1) AS bought, count(*) FILTER (WHERE side = -1) AS sold FROM trades GROUP BY mint, owner) x GROUP BY mint")
statement("divergence", "SELECT node, mint, CAST(sum(inflow) AS BIGINT) AS inflow, CAST(sum(outflow) AS BIGINT) AS outflow, CAST(sum(inflow) - sum(outflow) AS BIGINT) AS net FROM (SELECT owner AS node, mint, qty AS inflow, 0 AS outflow FROM trades WHERE side = 1 UNION ALL SELECT owner AS node, mint, 0 AS inflow, qty AS outflow FROM trades WHERE side = -1) x GROUP BY node, mint")
statement("standardize", f"SELECT mint, {q('(v - avg(v) OVER ()) / nullif(stddev_pop(v) OVER (), 0)', 6)} AS z FROM (SELECT mint, CAST(sum(qty) AS DOUBLE) AS v FROM trades GROUP BY mint) x")
statement("weighted_return", "SELECT owner, CAST(sum(delta) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0) AS weighted FROM trades GROUP BY owner")
statement("exit_mix", "SELECT o_orderstatus AS reason, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM orders GROUP BY o_orderstatus")
statement("portfolio_rollup", "SELECT owner, CAST(sum(CASE WHEN status = 'O' THEN cents END) AS BIGINT) AS open_cents, CAST(sum(cents) AS BIGINT) AS all_cents FROM trades GROUP BY owner")
statement("wallet_activity_sets", "SELECT owner, count(DISTINCT mint) AS mints FROM trades GROUP BY owner")
statement("listing_error_census", "SELECT kind AS outcome, count(*) AS n FROM ev GROUP BY kind")
statement("per_day_census", "SELECT day, count(*) AS n, count(DISTINCT mint) AS mints FROM trades GROUP BY day")
statement("launch_rate_hourly", "SELECT (t div 3600) % 24 AS hour, count(*) AS launches FROM (SELECT mint, min(t) AS t FROM trades GROUP BY mint) x GROUP BY 1")
statement("chain_hourly_activity", f"SELECT (t div 3600) % 24 AS hour, count(*) AS n, count(DISTINCT owner) AS owners, {q('percentile(discount, 0.5)')} AS fee_median FROM trades GROUP BY 1")
statement("claim_decay", f"SELECT owner, {q('regr_slope(ln(n), CAST(d AS DOUBLE))', 8)} AS slope FROM (SELECT owner, d, count(*) AS n FROM trades GROUP BY owner, d) x GROUP BY owner HAVING count(*) >= 3")
statement("size_impact_within", f"WITH m AS (SELECT mint, avg(CAST(qty AS DOUBLE)) AS mq, avg(px) AS mp FROM trades GROUP BY mint) SELECT {q('sum((qty - mq) * (px - mp)) / nullif(sum((qty - mq) * (qty - mq)), 0)', 7)} AS gamma FROM trades JOIN m USING (mint)")
statement("linear_detrend", f"WITH r AS (SELECT mint, regr_slope(px, CAST(d AS DOUBLE)) AS b, avg(px) AS mp, avg(CAST(d AS DOUBLE)) AS md FROM trades GROUP BY mint) SELECT mint, slot, txi, owner, {q('px - mp - b * (d - md)', 3)} AS residual FROM trades JOIN r USING (mint)")
statement("stratified_sample_weights", "SELECT p.status, CAST(n AS DOUBLE) / k AS weight FROM (SELECT status, count(*) AS n FROM trades GROUP BY status) p JOIN (SELECT status, count(*) AS k FROM trades WHERE slot % 3 = 0 GROUP BY status) s ON p.status = s.status")
statement("slot_contention", "SELECT n AS shared, count(*) AS trades_n, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) / count(*) AS success FROM (SELECT side, count(*) OVER (PARTITION BY slot) AS n FROM trades) x GROUP BY n")
statement("edge_flow_classes", "SELECT CASE WHEN pools = 1 THEN 'single' WHEN pools = 2 THEN 'pair' ELSE 'route' END AS class, count(*) AS n FROM (SELECT slot, count(DISTINCT mint) AS pools FROM trades GROUP BY slot) x GROUP BY 1")
statement("wallet_markout_summary", "SELECT owner, CAST(sum(side * cents) AS BIGINT) AS net, CAST(sum(CAST(floor(cents * discount) AS BIGINT)) AS BIGINT) AS fees, count(DISTINCT mint) AS mints FROM trades GROUP BY owner")
statement("conditional_surface", "SELECT CAST(floor(discount * 50) AS BIGINT) AS d_bin, txi AS remaining, count(*) AS n, count(*) FILTER (WHERE side = 1) AS up FROM trades GROUP BY 1, 2")
statement("surface_predict_fallback", "WITH c AS (SELECT mint % 50 AS b, txi, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) / count(*) AS r FROM trades WHERE d < 400 GROUP BY 1, 2), m AS (SELECT mint % 50 AS b, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) / count(*) AS r FROM trades WHERE d < 400 GROUP BY 1), g AS (SELECT CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) / nullif(count(*), 0) AS r FROM trades WHERE d < 1000) SELECT l.slot, l.txi, l.owner, coalesce(c.r, m.r, g.r) AS p FROM trades l LEFT JOIN c ON c.b = l.mint % 50 AND c.txi = l.txi LEFT JOIN m ON m.b = l.mint % 50 CROSS JOIN g WHERE l.d >= 2000")
statement("venue_participation", "SELECT o.mint, owner, CAST(n AS DOUBLE) / total AS share, n * 2 >= total AS is_venue FROM (SELECT mint, owner, count(DISTINCT slot) AS n FROM trades GROUP BY mint, owner) o JOIN (SELECT mint, count(DISTINCT slot) AS total FROM trades GROUP BY mint) m ON o.mint = m.mint")
statement("policy_sweep_ips", f"SELECT CAST(tau AS DOUBLE) AS tau, {q('sum(CASE WHEN discount >= tau THEN side / (CAST(txi AS DOUBLE) + 1) END) / count(*)', 6)} AS ips, count(*) FILTER (WHERE discount >= tau) AS n FROM trades, (VALUES (0.02), (0.05), (0.08)) AS taus(tau) GROUP BY tau")
statement("overlap_check", "SELECT count(*) AS later, count(*) FILTER (WHERE b.mint IS NULL) AS missing FROM (SELECT DISTINCT mint, owner FROM trades WHERE d >= 1000) a LEFT JOIN (SELECT DISTINCT mint, owner FROM trades WHERE d < 1000) b ON a.mint = b.mint AND a.owner = b.owner", "SELECT count(*) AS later, count(*) - (SELECT count(*) FROM (SELECT mint, owner FROM trades WHERE d >= 1000 INTERSECT SELECT mint, owner FROM trades WHERE d < 1000) x) AS missing FROM (SELECT DISTINCT mint, owner FROM trades WHERE d >= 1000) y")
statement("competing_states", "SELECT state, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 'ran' WHEN o_orderstatus = 'F' THEN 'dead' WHEN o_orderstatus = 'P' THEN 'censored' ELSE 'alive' END AS state FROM orders) x GROUP BY state")
statement("outcome_vocabulary", "SELECT outcome, count(*) AS n FROM (SELECT mint, CASE WHEN count(*) < 5 THEN 'stillborn' WHEN max(px) >= 1.4 * min_by(px, struct(t, slot, txi, owner, cents)) THEN 'ran' WHEN max(d) < 2400 THEN 'died' ELSE 'alive' END AS outcome FROM trades GROUP BY mint) x GROUP BY outcome")
statement("hour_matrix", "SELECT day, " + ", ".join(f"count(*) FILTER (WHERE (t div 3600) % 24 = {h}) AS h{h:02d}" for h in range(24)) + " FROM trades GROUP BY day")
statement("dose_response_bins", f"WITH b AS (SELECT ntile(10) OVER (ORDER BY discount, slot, txi, owner, cents) AS bin, side, discount FROM trades) SELECT CAST(bin AS BIGINT) AS bin, {q('avg(discount)', 6)} AS dose, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) / count(*) AS rate FROM b GROUP BY bin")
statement("decile_contrast", f"WITH b AS (SELECT ntile(10) OVER (ORDER BY v, mint) AS bin, v, p FROM (SELECT mint, CAST(sum(qty) AS BIGINT) AS v, max(px) AS p FROM trades GROUP BY mint) x) SELECT {q('median(CASE WHEN bin = 10 THEN p END) - median(CASE WHEN bin = 1 THEN p END)')} AS contrast FROM b")
statement("epistemic_brier_exact", "SELECT y, CAST(sum((1000 * y - p) * (1000 * y - p)) AS BIGINT) AS brier_millionths, count(*) AS n FROM (SELECT quality AS y, CAST(doc_id % 1000 AS BIGINT) AS p FROM labels) x GROUP BY y")
statement("normalised_rank_power", "SELECT slot, (k + 1) / (12 * (k - 1)) AS variance FROM (SELECT slot, CAST(count(*) AS DOUBLE) AS k FROM trades GROUP BY slot) x WHERE k > 1")
statement("tape_health", "SELECT count(*) AS reference, count(*) FILTER (WHERE status = 'F') AS observed, CAST(count(*) FILTER (WHERE status = 'F') AS DOUBLE) / count(*) AS coverage FROM trades")
statement("capital_recovery", "SELECT owner, CAST(sum(CASE WHEN side = -1 THEN cents ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN side = 1 THEN cents ELSE 0 END) AS BIGINT) AS invested FROM trades GROUP BY owner")
