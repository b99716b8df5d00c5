"""Projections, filters, predicates and scalar functions."""

from tidemark.operators.sql import q, statement

statement("project_cast", "SELECT slot, txi, owner, CAST(qty AS DECIMAL(38,0)) AS qty_raw, CAST(side AS TINYINT) AS sign, CAST(cents AS DECIMAL(38,0)) AS cents_raw FROM trades")
statement("filter_conjunction", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_size <> 10 AND p_retailprice > 950")
statement("case_banding", "SELECT CASE WHEN discount < 0.02 THEN 'a <2%' WHEN discount < 0.05 THEN 'b 2-5%' WHEN discount < 0.08 THEN 'c 5-8%' ELSE 'd >=8%' END AS band, count(*) AS n FROM trades GROUP BY 1")
statement("case_classify_price_kind", "SELECT slot, txi, owner, CASE WHEN status = 'F' AND side = 1 THEN 'pool_fill' WHEN status = 'F' THEN 'curve_fill' WHEN status = 'O' AND qty > 10 THEN 'curve_model' ELSE 'unsupported' END AS price_kind FROM trades")
statement("fixed_bin_map", "SELECT mint, slot, txi, CASE WHEN discount <= 0.01 THEN -2 WHEN discount <= 0.03 THEN -1 WHEN discount <= 0.06 THEN 0 WHEN discount <= 0.08 THEN 1 ELSE 2 END AS d_bin FROM trades")
statement(
    "quartile_cell_key",
    """WITH cuts AS (SELECT percentile(CAST(qty AS DOUBLE), 0.25) AS q1, percentile(CAST(qty AS DOUBLE), 0.5) AS q2, percentile(CAST(qty AS DOUBLE), 0.75) AS q3,
       percentile(CAST(cents AS DOUBLE), 0.5) AS p2 FROM trades WHERE d < 1200)
SELECT concat_ws('|', CAST(CASE WHEN qty <= q1 THEN 0 WHEN qty <= q2 THEN 1 WHEN qty <= q3 THEN 2 ELSE 3 END AS VARCHAR(2)), CAST(CASE WHEN cents <= p2 THEN 0 ELSE 1 END AS VARCHAR(2))) AS cell, count(*) AS n
FROM trades, cuts WHERE d >= 1200 GROUP BY 1""",
)
statement("null_safe_ratio", "SELECT mint, CAST(sum(qty * qty) AS DOUBLE) / nullif(CAST(sum(delta) AS DOUBLE) * CAST(sum(delta) AS DOUBLE), 0) AS ratio FROM trades GROUP BY mint")
statement("between_gap_flag", "SELECT mint, max(CASE WHEN d BETWEEN 1000 AND 1010 THEN 1 ELSE 0 END) AS touches_gap FROM trades GROUP BY mint")
statement("interval_overlap_predicate", "SELECT call_id, NOT (t < 86400 * 1010 AND t + 3600 > 86400 * 1000) AS clear_1h, NOT (t < 86400 * 1010 AND t + 86400 > 86400 * 1000) AS clear_24h FROM calls")
statement("in_scalar_subquery", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 UNION SELECT user_id FROM events WHERE event_type = 'error') AS on_ladder FROM customer")
statement("scalar_subquery_projection", "SELECT (SELECT count(*) FROM customer) - count(DISTINCT o_custkey) AS customers_with_none, count(*) AS n FROM orders")
statement("correlated_count_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) > 0 AS has_large FROM customer c")
statement("null_fill_update", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(top, 0.0) AS top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
statement("plain_filter_as_known", "SELECT call_id, caller, mint FROM calls WHERE t <= 86400 * 1500 AND t + 86400 * (call_id % 7) <= 86400 * 1500 AND caller = 11")
statement("floor_bucket_time", "SELECT event_id, CAST(floor(t / 60) AS BIGINT) * 60 AS minute FROM ev")
statement("epoch_to_utc", "SELECT event_id, date_format(timestamp_seconds(t), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS iso FROM ev", "SELECT event_id, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM ev")
statement("utc_day_partition", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
statement("log_exp_pow", "SELECT mint, slot, txi, owner, -2.0 * ln(px + 1) AS logp, sqrt(px) AS root, power(px, 2) AS square, abs(delta) AS size FROM trades")
statement("round_half_up_ppm", "SELECT call_id, CAST(CASE WHEN num < 0 THEN -((2 * -num * 1000000 + den) div (2 * den)) ELSE (2 * num * 1000000 + den) div (2 * den) END AS BIGINT) AS ppm FROM (SELECT call_id, caller - 48 AS num, mint + 1 AS den FROM calls) x")
statement("ratio_compare_cross", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN (a.n_nationkey + 1) * (b.n_regionkey + 2) < (b.n_nationkey + 1) * (a.n_regionkey + 2) THEN -1 WHEN (a.n_nationkey + 1) * (b.n_regionkey + 2) > (b.n_nationkey + 1) * (a.n_regionkey + 2) THEN 1 ELSE 0 END AS cmp FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
statement("greatest_least", "SELECT mint, greatest(max(px), max(cents / 100.0D)) AS h, least(min(px), min(cents / 100.0D)) AS l FROM trades GROUP BY mint", "SELECT mint, greatest(max(px), max(cents / 100.0)) AS h, least(min(px), min(cents / 100.0)) AS l FROM trades GROUP BY mint")
statement("coalesce_nullif", "SELECT slot, txi, owner, coalesce(nullif(qty, 1), -1) AS qty FROM trades")
statement("try_cast", "SELECT c_custkey, try_cast(c_mktsegment AS BIGINT) AS as_number, try_cast(CAST(c_custkey AS VARCHAR(20)) AS INT) AS back FROM customer")
statement("list_unnest", "SELECT doc_id, word FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM documents) x", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
statement("list_transform_filter", "SELECT doc_id, CAST(size(array_distinct(filter(transform(split(text, ' '), w -> lower(w)), w -> length(w) > 6))) AS BIGINT) AS long_words FROM documents", "SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda w: lower(w)), lambda w: length(w) > 6))) AS long_words FROM documents")
statement("range_generate", "WITH b AS (SELECT min(d) AS lo, max(d) AS hi FROM trades) SELECT explode(sequence(lo, hi)) AS d FROM b")
statement("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM ev", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev")
statement("string_norm", "SELECT c_custkey, lower(trim(regexp_replace(c_name, '[^a-zA-Z0-9]+', ' '))) AS name FROM customer", "SELECT c_custkey, lower(trim(regexp_replace(c_name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS name FROM customer")
statement("squash_runs", "SELECT c_custkey, regexp_replace(c_name, '(0)0+', '$1') AS name FROM customer", "SELECT c_custkey, regexp_replace(c_name, '(0)0+', '\\1', 'g') AS name FROM customer")
statement("levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(a.n_name, b.n_name) <= 6 THEN levenshtein(a.n_name, b.n_name) END AS edits FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b, CAST(CASE WHEN levenshtein(a.n_name, b.n_name) <= 6 THEN levenshtein(a.n_name, b.n_name) END AS INTEGER) AS edits FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
statement("name_similarity", "SELECT a.n_name AS a, b.n_name AS b, 1 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)) AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
statement("trigrams", "SELECT n_nationkey, explode(array_distinct(transform(sequence(1, length(n_name) - 2), i -> substr(n_name, i, 3)))) AS gram FROM nation WHERE length(n_name) >= 3", "SELECT n_nationkey, unnest(list_distinct(list_transform(generate_series(1, length(n_name) - 2), lambda i: substr(n_name, i, 3)))) AS gram FROM nation WHERE length(n_name) >= 3")
statement(
    "boilerplate_share",
    """WITH w AS (SELECT DISTINCT source, doc_id, word FROM (SELECT source, doc_id, explode(split(text, ' ')) AS word FROM documents) x),
 f AS (SELECT source, word, count(*) AS df FROM w GROUP BY source, word), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT w.source, CAST(count(*) FILTER (WHERE df >= 0.2 * n.n) AS DOUBLE) / count(*) AS share FROM w JOIN f ON w.source = f.source AND w.word = f.word JOIN n ON n.source = w.source GROUP BY w.source""",
    """WITH w AS (SELECT DISTINCT source, doc_id, word FROM (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents) x),
 f AS (SELECT source, word, count(*) AS df FROM w GROUP BY source, word), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT w.source, CAST(count(*) FILTER (WHERE df >= 0.2 * n.n) AS DOUBLE) / count(*) AS share FROM w JOIN f ON w.source = f.source AND w.word = f.word JOIN n ON n.source = w.source GROUP BY w.source""",
)
statement("referral_share", "SELECT source, CAST(count(*) FILTER (WHERE text RLIKE 'https?://') AS DOUBLE) / count(*) AS share FROM documents GROUP BY source", "SELECT source, CAST(count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS DOUBLE) / count(*) AS share FROM documents GROUP BY source")
statement("extract_mints_regex", "SELECT doc_id, explode(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 0)) AS address FROM documents", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS address FROM documents")
statement("mul_div_floor", "SELECT slot, txi, owner, CAST((CAST(cents AS DECIMAL(18,0)) * CAST(qty AS DECIMAL(18,0))) AS BIGINT) div (mint + 1) AS lo FROM trades")
statement("cp_sell_out", "SELECT slot, txi, owner, (y * qty) div (x + qty) AS out FROM (SELECT slot, txi, owner, qty, mint * 100 + 1000 AS x, cents + 1 AS y FROM trades) r")
statement("min_out_slippage", "SELECT slot, txi, owner, ((y * qty) div (x + qty)) * (10000 - 150) div 10000 AS min_out FROM (SELECT slot, txi, owner, qty, mint * 100 + 1000 AS x, cents + 1 AS y FROM trades) r")
statement("curve_buy_sell", "SELECT slot, txi, owner, spend - (spend * 100) div 10000 AS net, (y * (spend - (spend * 100) div 10000)) div (x + spend - (spend * 100) div 10000) AS tokens FROM (SELECT slot, txi, owner, cents AS spend, mint * 1000 + 30000 AS x, CAST(1000000 AS BIGINT) AS y FROM trades) r")
statement("fee_schedule", "SELECT slot, txi, owner, tier, (cents * bps + 9999) div 10000 AS fee FROM trades JOIN (VALUES (1, 0, 500000, 100), (2, 500000, 2000000, 60), (3, 2000000, 9000000000, 30)) AS tiers(tier, lo, hi, bps) ON cents >= lo AND cents < hi")
statement("dlmm_fee_rate", "SELECT slot, txi, owner, base + variable AS total FROM (SELECT slot, txi, owner, 25 * (mint % 10 + 1) AS base, (qty * qty * 7 + 99) div 100 AS variable FROM trades) x")
statement("bin_price", f"SELECT DISTINCT p_size, {q('power(1 + p_size / 10000.0, p_size - 25)', 9)} AS price FROM part", f"SELECT DISTINCT p_size, {q('power(1 + p_size / 10000.0, p_size - 25)', 9)} AS price FROM part")
statement("optimal_size", "SELECT mint, slot, txi, CAST(floor(least(sqrt(CAST(cents AS DOUBLE) * 5000), cents * 0.02, 1000000)) AS BIGINT) AS size FROM trades", "SELECT mint, slot, txi, CAST(floor(least(sqrt(CAST(cents AS DOUBLE) * 5000), CAST(cents AS DOUBLE) * CAST(0.02 AS DOUBLE), 1000000)) AS BIGINT) AS size FROM trades")
statement("round_trip_friction", "SELECT mint, slot, txi, owner, 2 * (CAST(qty AS DOUBLE) / (mint + 1000) + discount) + 2 * CAST(5 AS DOUBLE) / cents AS friction FROM trades")
statement("fee_band_curl", f"SELECT slot, {q('sum(-ln(1 - discount))', 6)} AS band, {q('sum(side * ln(px))', 6)} AS curl FROM trades GROUP BY slot")
statement("bps_floor_ceil", "SELECT slot, txi, owner, (cents * 10000) div (mint * 100 + 7) AS bps_floor, (cents * 10000 + mint * 100 + 6) div (mint * 100 + 7) AS bps_ceil FROM trades")
statement("constant_product_exact_out", "SELECT slot, txi, owner, CASE WHEN qty >= y THEN 'refused' ELSE 'ok' END AS status, CASE WHEN qty < y THEN (x * qty + y - qty - 1) div (y - qty) + 1 END AS pay FROM (SELECT slot, txi, owner, qty, cents AS x, mint % 60 + 2 AS y FROM trades) r")
statement("basis_allocate", "SELECT slot, txi, owner, (cents * qty) div (qty + txi) AS basis, CASE WHEN status = 'F' THEN 'exact' ELSE 'estimated' END AS quality FROM trades")
statement("pool_depth_share", "SELECT mint, owner, CAST(sum(qty) * 10000 AS BIGINT) div CAST(max(total) AS BIGINT) AS share_bps FROM (SELECT mint, owner, qty, sum(qty) OVER (PARTITION BY mint) AS total FROM trades) x GROUP BY mint, owner")
statement("in_range_flag", "SELECT slot, txi, owner, txi BETWEEN 2 AND 5 AS in_range FROM trades")
statement("fee_tier_lookup", "SELECT call_id, rate FROM calls JOIN (VALUES (0.0, 50000.0, 95), (50000.0, 150000.0, 60), (150000.0, 1e12, 30)) AS tiers(lo, hi, rate) ON price >= lo AND price < hi")
statement("tx_classify", "SELECT slot, CASE WHEN count(DISTINCT side) = 2 THEN 'swap' WHEN max(side) = 1 THEN 'deposit' ELSE 'withdraw' END AS kind, min(owner) AS counterparty FROM trades GROUP BY slot")
