"""Composite studies of pools, positions, scenes and wallets, each one statement of windows and aggregates.

As-of lookups put the asking rows and the series into one window order; lookups ahead in a
bounded time meet by time buckets. Neither joins all pairs of a key.
"""

from tidemark.operators.sql import cut, q, resampled, statement

_ORDER = "d, slot, txi, owner, cents"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_CLOSE = "k AS (SELECT mint, d, max_by(px, struct(slot, txi, owner, cents)) AS close FROM trades GROUP BY mint, d)"


def ppm(n: str, d: str) -> str:
    """n / d in parts per million, halves away from zero, in whole numbers."""
    return f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ((2000000 * abs({n}) + {d}) div (2 * {d})))"


# Silences of a feed of over six hours: when the alarm goes off, and the event that ends it (none at the end of the tape).
statement(
    "liveness_monitor",
    "WITH e AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM ev), z AS (SELECT max(t) AS now_ FROM ev) SELECT user_id, t + 21600 AS stale_since, nxt AS cleared_at, coalesce(nxt, now_) - t AS silent_seconds FROM e, z WHERE coalesce(nxt, now_) - t > 21600",
)

# A position closes at the first trade of its mint at or after its deadline.
statement(
    "deadline_heap",
    """WITH b AS (SELECT mint, t + 432000 AS t, 0 AS tick, call_id, price FROM calls UNION ALL SELECT mint, t, 1, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM trades),
 n AS (SELECT call_id, t AS deadline, first_value(CASE WHEN tick = 1 THEN t END) IGNORE NULLS OVER (PARTITION BY mint ORDER BY t, tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closed_at, tick FROM b)
SELECT call_id, deadline, closed_at, closed_at - deadline AS late FROM n WHERE tick = 0""",
    "SELECT call_id, t + 432000 AS deadline, (SELECT min(l.t) FROM trades l WHERE l.mint = c.mint AND l.t >= c.t + 432000) AS closed_at, (SELECT min(l.t) FROM trades l WHERE l.mint = c.mint AND l.t >= c.t + 432000) - t - 432000 AS late FROM calls c",
)

# Rolling flow of a pool: notional and swaps of 90 days, realised variance of the daily grid in it, value locked.
statement(
    "pool_flow_state",
    f"""WITH g AS (SELECT mint, d, sum(cents) AS cents, count(*) AS swaps, sum(delta) AS delta, max_by(px, struct(slot, txi, owner, cents)) AS px FROM trades GROUP BY mint, d),
 l AS (SELECT *, ln(px) AS lp FROM g), r AS (SELECT *, lp - lag(lp) OVER (PARTITION BY mint ORDER BY d) AS step, d - lag(d) OVER (PARTITION BY mint ORDER BY d) AS gap FROM l)
SELECT mint, d, CAST(sum(cents) OVER w AS BIGINT) AS notional_cents, CAST(sum(swaps) OVER w AS BIGINT) AS swaps, {q('coalesce(sum(CASE WHEN gap <= 90 THEN step * step END) OVER w, 0)', 5)} AS realised_variance, {q('lp - first_value(lp) OVER w', 6)} AS net_displacement, {cut(f'greatest(sum(delta) OVER (PARTITION BY mint ORDER BY d {_SO_FAR}), 0) * px', 2)} AS value_locked
FROM r WINDOW w AS (PARTITION BY mint ORDER BY d RANGE BETWEEN 90 PRECEDING AND CURRENT ROW)""",
)

# Exact shape of a mint's daily closes in cents: change and range of the start, drawdown of the running peak, turns.
statement(
    "chart_shape_features",
    f"""WITH k AS (SELECT mint, d, CAST(floor(max_by(px, struct(slot, txi, owner, cents)) * 100 + 0.5) AS BIGINT) AS c FROM trades GROUP BY mint, d),
 w AS (SELECT mint, d, c, max(c) OVER (PARTITION BY mint ORDER BY d {_SO_FAR}) AS peak, sign(c - lag(c) OVER (PARTITION BY mint ORDER BY d)) AS s FROM k),
 t AS (SELECT mint, d, c, peak, s, lag(s) OVER (PARTITION BY mint ORDER BY d) AS before FROM (SELECT * FROM w WHERE s <> 0 OR s IS NULL) x),
 f AS (SELECT mint, min_by(c, d) AS first, max_by(c, d) AS last, max(c) AS high, min(c) AS low, max({ppm('(peak - c)', 'peak')}) AS drawdown FROM w WHERE c > 0 GROUP BY mint)
SELECT f.mint, {ppm('(last - first)', 'first')} AS change_ppm, {ppm('(high - low)', 'first')} AS range_ppm, drawdown AS drawdown_ppm, turns FROM f JOIN (SELECT mint, count(*) FILTER (WHERE s * before < 0) AS turns FROM t GROUP BY mint) y ON y.mint = f.mint""",
)

# Fee side and loss side of a band of each width around the active bin, per day, and their width-free ratio.
_BIN = "ln(CAST(1.0025 AS DOUBLE))"
statement(
    "liquidity_panel",
    f"""WITH g AS (SELECT mint, t, cents, cents * discount AS fee, greatest(sum(delta) OVER w, 0) * px * 100 AS locked, ln(px) - lag(ln(px)) OVER w AS r FROM trades WINDOW w AS (PARTITION BY mint ORDER BY {_ORDER})),
 p AS (SELECT mint, count(*) AS swaps, greatest(max(t) - min(t), 1) / CAST(86400 AS DOUBLE) AS days, CAST(sum(cents) AS DOUBLE) AS volume, sum(fee) AS fees, sum(r * r) AS v, max(locked) AS tvl FROM g GROUP BY mint HAVING count(*) > 1)
SELECT mint, width, swaps, {q('volume / days', 1)} AS volume_per_day, {cut('fees / days', 1)} AS fee_per_day, {q('fees / days / tvl / (2 * width + 1)', 9)} AS fee_side, {q(f'v / days / (8 * (width + CAST(0.5 AS DOUBLE)) * {_BIN})', 5)} AS loss_side, {q(f'4 * (fees / days) * {_BIN} / (tvl * v / days)', 10)} AS dial
FROM p, (VALUES (1), (2), (3), (5), (8), (13), (21), (34)) AS ws(width) WHERE tvl > 0 AND v > 0""",
)

# Deposits, withdrawals and fees of a position, what is left of it at the mint's last price, net and gross.
statement(
    "lp_ledger_reconstruct",
    """WITH l AS (SELECT mint, max_by(px, struct(d, slot, txi, owner, cents)) AS px FROM trades GROUP BY mint),
 p AS (SELECT owner, mint, CAST(sum(CASE WHEN side = 1 THEN cents ELSE 0 END) AS BIGINT) AS deposited, CAST(sum(CASE WHEN side = -1 THEN cents ELSE 0 END) AS BIGINT) AS withdrawn, CAST(sum(CAST(floor(cents * tax) AS BIGINT)) AS BIGINT) AS fees, CAST(greatest(sum(delta), 0) AS BIGINT) AS units FROM trades GROUP BY owner, mint)
SELECT owner, p.mint, deposited, withdrawn, fees, CAST(floor(units * px * 100 + 0.5) AS BIGINT) AS open_value, withdrawn + CAST(floor(units * px * 100 + 0.5) AS BIGINT) - deposited AS gross, withdrawn + CAST(floor(units * px * 100 + 0.5) AS BIGINT) + fees - deposited AS net FROM p JOIN l ON l.mint = p.mint""",
)

# A day with a call is a scene; its members are the mints of that day's trades and calls.
_SCENES = """c AS (SELECT DISTINCT t div 86400 AS d, mint FROM calls), m AS (SELECT d, mint, CAST(sum(delta) AS BIGINT) AS flow FROM trades GROUP BY d, mint),
 s AS (SELECT coalesce(m.d, c.d) AS d, coalesce(m.mint, c.mint) AS mint, c.mint IS NOT NULL AS chosen, coalesce(flow, 0) AS outcome FROM m FULL OUTER JOIN c ON c.d = m.d AND c.mint = m.mint),
 e AS (SELECT d, mint, chosen, outcome, count(*) OVER (PARTITION BY d) AS k, sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY d) AS n_chosen FROM s)"""
statement("selection_events", f"WITH {_SCENES} SELECT d, mint, chosen, k, CAST(n_chosen AS BIGINT) AS n_chosen FROM e WHERE n_chosen > 0")


def selection_score(h, draws: int = 29) -> str:
    """Mean normalised rank of the chosen members' flow, over scenes with a choice, and its p value over draws of as many members of each scene."""
    return f"""WITH {_SCENES}, r AS (SELECT d, mint, chosen, n_chosen, (rank() OVER (PARTITION BY d ORDER BY outcome) - 1 + (count(*) OVER (PARTITION BY d, outcome) - 1) / CAST(2 AS DOUBLE)) / (k - 1) AS r FROM e WHERE n_chosen > 0 AND n_chosen < k),
 o AS (SELECT avg(r) AS score, count(*) AS scenes FROM (SELECT d, avg(r) AS r FROM r WHERE chosen GROUP BY d) x),
 g AS (SELECT d, mint, n_chosen, r, explode(sequence(1, {draws})) AS b FROM r),
 p AS (SELECT d, b, r, n_chosen, row_number() OVER (PARTITION BY d, b ORDER BY {h("concat('scene', CAST(b AS STRING), '-', CAST(d AS STRING), '-', CAST(mint AS STRING))")}, mint) AS rn FROM g),
 n AS (SELECT b, avg(r) AS score FROM (SELECT d, b, avg(r) AS r FROM p WHERE rn <= n_chosen GROUP BY d, b) x GROUP BY b)
SELECT {q('max(o.score)', 7)} AS score, max(o.scenes) AS scenes, CAST(1 + count(*) FILTER (WHERE abs(n.score - 0.5) >= abs(o.score - 0.5) - 1e-12) AS DOUBLE) / (1 + count(*)) AS p FROM n, o"""


resampled("selection_score", selection_score)

# Normal quantiles of a two-sided 5 % test and of 80 % power.
statement(
    "power_sample_size",
    f"WITH {_SCENES}, v AS (SELECT DISTINCT k, CAST(n_chosen AS BIGINT) AS m FROM e WHERE n_chosen > 0 AND n_chosen < k) SELECT k, m, CAST(delta AS DOUBLE) AS delta, CAST(ceil((1.959964 + 0.841621) * (1.959964 + 0.841621) * (k + 1) * (k - m) / (12 * m * CAST((k - 1) * (k - 1) AS DOUBLE)) / (delta * delta)) AS BIGINT) AS scenes FROM v, (VALUES (0.05), (0.1), (0.2)) AS ds(delta)",
)


def normal_cdf(x: str) -> str:
    """The normal distribution function, to 1e-7 (a rational approximation; its numbers are fixed values)."""
    t = f"(1 / (1 + CAST(0.2316419 AS DOUBLE) * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_upper_quantile(p: str) -> str:
    """x above which a normal value lies with probability p <= 0.5, to 5e-4 (a rational approximation; its numbers are fixed values)."""
    t = f"sqrt(-2 * ln({p}))"
    return f"({t} - (2.515517D + {t} * (0.802853D + {t} * 0.010328D)) / (1 + {t} * (1.432788D + {t} * (0.189269D + {t} * 0.001308D))))"


# The brand's best mint by Sharpe ratio of its price steps, deflated by the number of mints tried and the non-normality of its steps.
_DSR = f"""WITH g AS (SELECT mint, ln(px) - lag(ln(px)) OVER (PARTITION BY mint ORDER BY {_ORDER}) AS r FROM trades),
 m AS (SELECT mint, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd FROM g GROUP BY mint HAVING count(r) > 3),
 h AS (SELECT m.mint, max(n) AS n, max(mu / sd) AS sr, avg(pow((r - mu) / sd, 3)) AS skew, avg(pow((r - mu) / sd, 4)) AS kurt FROM g JOIN m ON m.mint = g.mint WHERE r IS NOT NULL AND sd > 0 GROUP BY m.mint),
 b AS (SELECT p_brand, count(*) AS trials, stddev_samp(sr) AS spread, max_by(struct(sr, n, skew, kurt), struct(sr, mint)) AS best FROM h JOIN part ON p_partkey = mint GROUP BY p_brand HAVING count(*) > 2),
 d AS (SELECT p_brand, trials, best.sr AS sr, spread * ((1 - 0.5772156649015329D) * {normal_upper_quantile('(CAST(1 AS DOUBLE) / trials)')} + 0.5772156649015329D * {normal_upper_quantile('(CAST(1 AS DOUBLE) / trials / exp(CAST(1 AS DOUBLE)))')}) AS bar, best.n AS n, 1 - best.skew * best.sr + (best.kurt - 1) / 4 * best.sr * best.sr AS v FROM b)
SELECT p_brand, trials, {q('sr', 6)} AS observed, {q('bar', 6)} AS expected_max, {q(normal_cdf('((sr - bar) * sqrt(n - 1) / sqrt(v))'), 5)} AS probability FROM d WHERE v > 0"""
_DSR_DUCK = _DSR.replace("struct(sr, n, skew, kurt)", "{'sr': sr, 'n': n, 'skew': skew, 'kurt': kurt}")
for _n in ("0.5772156649015329", "0.319381530", "0.356563782", "1.781477937", "1.821255978", "1.330274429", "2.515517", "0.802853", "0.010328", "1.432788", "0.189269", "0.001308"):
    _DSR_DUCK = _DSR_DUCK.replace(_n + "D", f"CAST({_n} AS DOUBLE)")
statement("deflated_sharpe", _DSR, _DSR_DUCK)

# The largest front run that a buyer's slippage bears is the root of a quadratic; the best one is sought on 400 steps up to it.
_CPMM = "WITH v AS (SELECT slot, txi, owner, cents, CAST(1000000 AS DOUBLE) AS y, px * qty AS b, CAST(0.01 AS DOUBLE) * txi AS s, CAST(0.003 AS DOUBLE) AS phi FROM trades WHERE side = 1), a AS (SELECT *, b * (1 - phi) AS e, (1 - phi) * (y + b * (1 - phi)) + y AS lin, y * (y + b * (1 - phi)) * (1 - 1 / (1 - s)) AS con FROM v), f AS (SELECT *, (-lin + sqrt(lin * lin - 4 * (1 - phi) * con)) / (2 * (1 - phi)) AS top FROM a), i AS (SELECT *, explode(sequence(0, 400)) AS i FROM f), g AS (SELECT *, top * (i / CAST(400 AS DOUBLE)) AS x FROM i), t AS (SELECT *, x * (1 - phi) / (y + x * (1 - phi)) AS got FROM g), u AS (SELECT *, (1 - got) * e / (y + x + e) AS victim FROM t), p AS (SELECT slot, txi, owner, cents, x, (y + x + b) * got * (1 - phi) / ((1 - got - victim) + got * (1 - phi)) - x AS profit FROM u)"
statement("sandwich_optimum", f"{_CPMM} SELECT slot, txi, owner, cents, {cut('max(profit)', 3)} AS profit FROM p GROUP BY slot, txi, owner, cents")

# Members of a slot in the order of their numbers; the plan (replans.py) follows their reserves.
statement("slot_chain_order", "SELECT slot, txi, CAST(row_number() OVER (PARTITION BY slot ORDER BY txi, owner, cents) - 1 AS BIGINT) AS place FROM trades")

# A wallet's transactions of one slot and mint: both sides are a recentering, one is an entry or an exit; each kind with its value.
statement("shuffle_split", "SELECT kind, count(*) AS n, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM (SELECT slot, owner, CASE WHEN sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN side = -1 THEN 1 ELSE 0 END) > 0 THEN 'recenter' WHEN max(side) = 1 THEN 'enter' ELSE 'leave' END AS kind, sum(CASE WHEN side = 1 THEN cents ELSE 0 END) AS added, sum(CASE WHEN side = -1 THEN cents ELSE 0 END) AS removed FROM trades GROUP BY slot, owner) x GROUP BY kind")

# Charge, voltage and energy of a pool: its depth moves by the net flow over the log price.
statement("capacitance_energy", f"WITH g AS (SELECT mint, CAST(sum(delta) AS DOUBLE) AS charge, ln(max_by(px, struct({_ORDER})) / min_by(px, struct({_ORDER}))) AS volts, greatest(max(d) - min(d), 1) AS days FROM trades GROUP BY mint) SELECT mint, {q('volts', 6)} AS volts, {q('charge / volts', 4)} AS capacitance, {q('charge * volts / 2', 4)} AS energy, {q('volts * days / nullif(charge, 0)', 6)} AS resistance FROM g WHERE abs(volts) > 1e-9")

# The map's nodes and edges in one relation.
statement(
    "netmap_build",
    """WITH e AS (SELECT owner, mint, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(delta) AS BIGINT) AS net FROM trades GROUP BY owner, mint)
SELECT 'edge' AS kind, owner AS a, mint AS b, n, cents, net FROM e UNION ALL SELECT 'wallet', owner, CAST(NULL AS BIGINT), count(*), CAST(sum(cents) AS BIGINT), CAST(sum(net) AS BIGINT) FROM e GROUP BY owner UNION ALL SELECT 'pool', CAST(NULL AS BIGINT), mint, count(*), CAST(sum(cents) AS BIGINT), CAST(sum(net) AS BIGINT) FROM e GROUP BY mint""",
)

# One row for each wallet and each coin, with its behaviour and its chief counterpart.
statement(
    "dossier_index_build",
    """WITH e AS (SELECT owner, mint, count(*) AS n, min(d) AS first_d, max(d) AS last_d, CAST(sum(side * cents) AS BIGINT) AS net FROM trades GROUP BY owner, mint)
SELECT 'wallet' AS kind, owner AS id, CAST(sum(n) AS BIGINT) AS trades_n, count(*) AS counterparts, min(first_d) AS first_d, max(last_d) AS last_d, CAST(sum(net) AS BIGINT) AS net_cents, max_by(mint, struct(n, mint)) AS chief FROM e GROUP BY owner
UNION ALL SELECT 'coin', mint, CAST(sum(n) AS BIGINT), count(*), min(first_d), max(last_d), CAST(sum(net) AS BIGINT), max_by(owner, struct(n, owner)) FROM e GROUP BY mint""",
)

# Each leg with the mint's last close before its day and the first one 30 days on or later.
_PRICED = f"""WITH {_CLOSE}, b AS (SELECT mint, d, 0 AS o, close, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS INT) AS txi, CAST(NULL AS BIGINT) AS owner, CAST(NULL AS BIGINT) AS cents, 0 AS h FROM k UNION ALL SELECT mint, d - 1, 1, NULL, slot, txi, owner, cents, 0 FROM trades UNION ALL SELECT mint, d + 30, -1, NULL, slot, txi, owner, cents, 1 FROM trades),
 a AS (SELECT mint, slot, txi, owner, cents, h, o, last_value(close) IGNORE NULLS OVER (PARTITION BY mint ORDER BY d, o {_SO_FAR}) AS before, first_value(close) IGNORE NULLS OVER (PARTITION BY mint ORDER BY d, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM b)
SELECT mint, slot, txi, owner, cents, max(CASE WHEN h = 0 THEN before END) AS close_before, max(CASE WHEN h = 1 THEN after END) AS close_after_30 FROM a WHERE o <> 0 GROUP BY mint, slot, txi, owner, cents"""
statement("quality_priced_panel", _PRICED, f"WITH {_CLOSE} SELECT mint, slot, txi, owner, cents, (SELECT max_by(close, k.d) FROM k WHERE k.mint = l.mint AND k.d < l.d) AS close_before, (SELECT min_by(close, k.d) FROM k WHERE k.mint = l.mint AND k.d >= l.d + 30) AS close_after_30 FROM trades l")

# A day's calls and trades by caller and coin: words said, what was held at its end.
statement(
    "debrief_day",
    f"""WITH w AS (SELECT t div 86400 AS d, mint, count(*) AS calls_n, count(DISTINCT caller) AS callers FROM calls GROUP BY 1, 2), a AS (SELECT d, mint, count(*) AS trades_n, CAST(sum(delta) AS BIGINT) AS net FROM trades GROUP BY d, mint)
SELECT d, mint, coalesce(calls_n, 0) AS calls_n, coalesce(callers, 0) AS callers, coalesce(trades_n, 0) AS trades_n, CAST(sum(coalesce(net, 0)) OVER (PARTITION BY mint ORDER BY d {_SO_FAR}) AS BIGINT) AS held FROM w FULL OUTER JOIN a USING (d, mint)""",
)

# Per epoch: divergence of the flow between wallets and coins, and what only goes round between two of them.
statement(
    "dynamic_fields",
    f"""WITH e AS (SELECT d div 200 AS epoch, owner, mint, CAST(sum(CASE WHEN side = 1 THEN qty ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN side = -1 THEN qty ELSE 0 END) AS BIGINT) AS o FROM trades GROUP BY 1, 2, 3),
 v AS (SELECT epoch, CAST(sum(abs(n)) AS BIGINT) AS divergence FROM (SELECT epoch, owner, sum(i - o) AS n FROM e GROUP BY epoch, owner) x GROUP BY epoch)
SELECT e.epoch, max(divergence) AS divergence, CAST(sum(least(i, o)) AS BIGINT) AS circulation, CAST(sum(i + o) AS BIGINT) AS volume, count(*) AS edges FROM e JOIN v ON v.epoch = e.epoch GROUP BY e.epoch""",
)

# Labels over the graph of wallets and coins, in the order wallets first: a side has no links inside, so its nodes may move at once. A node takes the label of the largest weight around it, the smallest on ties; three rounds.
_LPA = "w AS (SELECT owner, 100000000 + mint AS coin, CAST(sum(qty) AS BIGINT) AS w FROM trades GROUP BY owner, mint), c0 AS (SELECT DISTINCT coin AS node, coin AS label FROM w)"
for _i in range(3):
    _LPA += f", o{_i + 1} AS (SELECT owner AS node, min_by(label, struct(-s, label)) AS label FROM (SELECT owner, label, sum(w) AS s FROM w JOIN c{_i} ON node = coin GROUP BY owner, label) x GROUP BY owner), c{_i + 1} AS (SELECT coin AS node, min_by(label, struct(-s, label)) AS label FROM (SELECT coin, label, sum(w) AS s FROM w JOIN o{_i + 1} ON node = owner GROUP BY coin, label) x GROUP BY coin)"
statement("label_propagation", f"WITH {_LPA} SELECT node, label FROM o3 UNION ALL SELECT node, label FROM c3")

# What a policy decides at each quote after a call, in order of precedence: rug, stop, take profit (both when two quotes in a row say so), trailing stop; a position ends at its first exit.
_POSITIONS = f"""{_CLOSE}, c AS (SELECT call_id, mint, t div 86400 AS d FROM calls),
 j AS (SELECT c.call_id, k.d, k.close FROM (SELECT *, explode(sequence(d div 120, d div 120 + 1)) AS b FROM c) c JOIN (SELECT *, d div 120 AS b FROM k) k ON k.mint = c.mint AND k.b = c.b AND k.d >= c.d AND k.d <= c.d + 120)"""
_POSITIONS_PAIRS = f"{_CLOSE}, c AS (SELECT call_id, mint, t // 86400 AS d FROM calls), j AS (SELECT c.call_id, k.d, k.close FROM c JOIN k ON k.mint = c.mint AND k.d BETWEEN c.d AND c.d + 120)"
_RULES = f""", q AS (SELECT call_id, d, close, first_value(close) OVER w AS entry, max(close) OVER w AS peak FROM j WINDOW w AS (PARTITION BY call_id ORDER BY d {_SO_FAR})),
 s AS (SELECT *, close <= 0.8 * entry AS down, close >= 1.5 * entry AS up FROM q),
 f AS (SELECT *, coalesce(lag(down) OVER (PARTITION BY call_id ORDER BY d), false) AS down_before, coalesce(lag(up) OVER (PARTITION BY call_id ORDER BY d), false) AS up_before FROM s),
 e AS (SELECT call_id, d, close, entry, CASE WHEN close <= 0.3 * peak THEN 'rug' WHEN down AND down_before THEN 'stop' WHEN up AND up_before THEN 'take_profit' WHEN peak >= 1.3 * entry AND close <= 0.75 * peak THEN 'trail' END AS exit_ FROM f)
SELECT call_id, coalesce(min_by(exit_, CASE WHEN exit_ IS NOT NULL THEN d END), 'hold') AS exit_, min(CASE WHEN exit_ IS NOT NULL THEN d END) AS at, {cut('min_by(close / entry, CASE WHEN exit_ IS NOT NULL THEN d END) - 1', 6)} AS pnl FROM e GROUP BY call_id"""
statement("evaluate_position_rules", f"WITH {_POSITIONS}{_RULES}", f"WITH {_POSITIONS_PAIRS}{_RULES}")

# Causal excitation by earlier purchases and sales under an exponential kernel (a decay of 0.02 a day, from the event's and the last period of 400 days): each period starts from its predecessor's events, so a period of a mint is one window.
_DECAY, _PERIOD = "CAST(0.02 AS DOUBLE)", 400
_HAWKES = f"""WITH e AS (SELECT mint, d, slot, txi, owner, cents, side, d div {_PERIOD} AS p FROM trades), h AS (SELECT mint, d, slot, txi, owner, cents, side, p, true AS own FROM e UNION ALL SELECT mint, d, slot, txi, owner, cents, side, p + 1, false FROM e),
 x AS (SELECT *, exp({_DECAY} * (d - p * {_PERIOD})) AS up, exp(-{_DECAY} * (d - p * {_PERIOD})) AS down FROM h),
 s AS (SELECT mint, slot, txi, owner, cents, own, down * coalesce(sum(CASE WHEN side = 1 THEN up END) OVER w, 0) AS buys, down * coalesce(sum(CASE WHEN side = -1 THEN up END) OVER w, 0) AS sells FROM x WINDOW w AS (PARTITION BY mint, p ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT mint, slot, txi, owner, cents, {q('buys', 6)} AS excited_by_buys, {q('sells', 6)} AS excited_by_sells FROM s WHERE own"""
_HAWKES_PAIRS = f"SELECT x.mint, x.slot, x.txi, x.owner, x.cents, {q(f'coalesce(sum(CASE WHEN y.side = 1 THEN exp(-{_DECAY} * (x.d - y.d)) END), 0)', 6)} AS excited_by_buys, {q(f'coalesce(sum(CASE WHEN y.side = -1 THEN exp(-{_DECAY} * (x.d - y.d)) END), 0)', 6)} AS excited_by_sells FROM trades x LEFT JOIN trades y ON y.mint = x.mint AND y.d < x.d AND y.d // {_PERIOD} >= x.d // {_PERIOD} - 1 GROUP BY x.mint, x.slot, x.txi, x.owner, x.cents"
statement("hawkes_intensity", _HAWKES, _HAWKES_PAIRS)

# Pages of five events, newest first, are walked back to a user's mark or for three pages: what is new, what was seen twice, and whether the walk ended before the mark.
_WALK = "w AS (SELECT user_id, event_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) - 1) div 5 AS page FROM ev), m AS (SELECT user_id, max(t) - 86400 * 3 AS mark FROM ev GROUP BY user_id), r AS (SELECT w.user_id, min(CASE WHEN t <= mark THEN page END) AS reached, max(page) AS last_page FROM w JOIN m ON m.user_id = w.user_id GROUP BY w.user_id)"
statement("http_page_walk", f"WITH {_WALK} SELECT w.user_id, CAST(least(coalesce(max(reached), max(last_page)) + 1, 3) AS BIGINT) AS pages, count(*) FILTER (WHERE t > mark AND page < least(coalesce(reached, last_page) + 1, 3)) AS fresh, count(*) FILTER (WHERE t <= mark AND page < least(coalesce(reached, last_page) + 1, 3)) AS overlap, coalesce(max(reached), max(last_page) + 1) > 2 AS truncated FROM w JOIN m ON m.user_id = w.user_id JOIN r ON r.user_id = w.user_id GROUP BY w.user_id")

# Log prices between nations as a circuit: the sum around each triangle, largest first. As many edges as pairs of nations.
_VENUES = "p AS (SELECT c_nationkey AS a, s_nationkey AS b, avg(ln(px)) AS l FROM trades JOIN orders ON o_orderkey = slot JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = owner GROUP BY c_nationkey, s_nationkey), e AS (SELECT x.a, x.b, (x.l - y.l) / 2 AS l FROM p x JOIN p y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b)"
statement("circuit_snapshot", f"WITH {_VENUES} SELECT x.a, x.b, y.b AS c, {q('x.l + y.l - z.l', 6)} AS curl, {q('abs(x.l + y.l - z.l) / (abs(x.l) + abs(y.l) + abs(z.l))', 6)} AS share FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b")
