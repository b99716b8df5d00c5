"""Wallet accounting, outcomes and evaluation splits.

FIFO matching needs no loop: acquisitions and disposals are intervals on one axis, the
number of units so far, and a disposal consumes the lots that its interval meets. With
sales beyond the inventory the consumed units are those acquired less the inventory,
a walk that is held at zero. Both axes are cut at all ends once, in one window order, so a
wallet's lots and sales never meet in pairs.
"""

from tidemark.operators.sql import cut, q, resampled, statement

_KEY = "PARTITION BY owner, mint ORDER BY d, slot, txi, cents"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_WALK = f"""l AS (SELECT owner, mint, d, slot, txi, side, qty, cents, sum(delta) OVER ({_KEY} {_SO_FAR}) AS walk, sum(CASE WHEN side = 1 THEN qty ELSE 0 END) OVER ({_KEY} {_SO_FAR}) AS bought FROM trades),
 i AS (SELECT *, bought - (walk - least(0, min(walk) OVER ({_KEY} {_SO_FAR}))) AS consumed FROM l),
 c AS (SELECT *, consumed - coalesce(lag(consumed) OVER ({_KEY}), 0) AS matched FROM i)"""
_FIFO = f"""WITH {_WALK},
 ends AS (SELECT owner, mint, bought AS place, CAST(cents AS DOUBLE) / qty AS unit_cost, CAST(NULL AS BIGINT) AS sale_slot, CAST(NULL AS BIGINT) AS sale_txi FROM c WHERE side = 1
  UNION ALL SELECT owner, mint, consumed, CAST(NULL AS DOUBLE), slot, CAST(txi AS BIGINT) FROM c WHERE side = -1 AND matched > 0),
 cut AS (SELECT owner, mint, place, max(unit_cost) AS unit_cost, max(sale_slot) AS sale_slot, max(sale_txi) AS sale_txi FROM ends GROUP BY owner, mint, place),
 pieces AS (SELECT owner, mint, place - coalesce(lag(place) OVER (PARTITION BY owner, mint ORDER BY place), 0) AS units, first_value(unit_cost) IGNORE NULLS OVER w AS unit_cost, first_value(sale_slot) IGNORE NULLS OVER w AS slot, first_value(sale_txi) IGNORE NULLS OVER w AS txi FROM cut WINDOW w AS (PARTITION BY owner, mint ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 cost AS (SELECT owner, mint, slot, txi, sum(units * unit_cost) AS cost FROM pieces WHERE slot IS NOT NULL GROUP BY owner, mint, slot, txi)
SELECT c.owner, c.mint, c.slot, c.txi, CAST(c.qty AS BIGINT) AS sold, CAST(c.matched AS BIGINT) AS matched, {q('c.cents - coalesce(cost.cost, 0)', 2)} AS realized_cents, {q('coalesce(cost.cost, 0)', 2)} AS cost_cents, CASE WHEN c.matched < c.qty THEN 'tainted' ELSE 'exact' END AS basis_quality
FROM c LEFT JOIN cost ON cost.owner = c.owner AND cost.mint = c.mint AND cost.slot = c.slot AND cost.txi = c.txi WHERE c.side = -1"""
#: The oracle's other form: every sale against every lot of the same wallet and mint, by the overlap of their intervals.
_FIFO_PAIRS = f"""WITH {_WALK},
 b AS (SELECT owner, mint, bought - qty AS lo, bought AS hi, CAST(cents AS DOUBLE) / qty AS unit_cost FROM c WHERE side = 1)
SELECT c.owner, c.mint, c.slot, c.txi, CAST(c.qty AS BIGINT) AS sold, CAST(any_value(c.matched) AS BIGINT) AS matched, {q('any_value(c.cents) - coalesce(sum((least(consumed, hi) - greatest(consumed - matched, lo)) * unit_cost), 0)', 2)} AS realized_cents, {q('coalesce(sum((least(consumed, hi) - greatest(consumed - matched, lo)) * unit_cost), 0)', 2)} AS cost_cents, CASE WHEN any_value(c.matched) < c.qty THEN 'tainted' ELSE 'exact' END AS basis_quality
FROM c LEFT JOIN b ON b.owner = c.owner AND b.mint = c.mint AND b.lo < c.consumed AND b.hi > c.consumed - c.matched AND c.matched > 0 WHERE c.side = -1 GROUP BY c.owner, c.mint, c.slot, c.txi, c.qty"""
statement("fifo_pnl", _FIFO, _FIFO_PAIRS)

# Average cost: a purchase on a flat book opens an episode; each later one dilutes the basis by the share of units held before. The product of dilutions is a running sum of logarithms.
_EPI = "PARTITION BY owner, mint, episode ORDER BY d, slot, txi, cents"
_BASIS = f"""WITH f AS (SELECT owner, mint, d, slot, txi, cents, delta, px, greatest(sum(delta) OVER ({_KEY} {_SO_FAR}) - delta, 0) AS held FROM trades),
 o AS (SELECT *, sum(CASE WHEN delta > 0 AND held = 0 THEN 1 ELSE 0 END) OVER ({_KEY} {_SO_FAR}) AS episode FROM f),
 s AS (SELECT *, CASE WHEN delta > 0 AND held > 0 THEN ln(CAST(held AS DOUBLE) / (held + delta)) ELSE CAST(0 AS DOUBLE) END AS log_keep, CASE WHEN delta > 0 THEN px * delta / (held + delta) ELSE CAST(0 AS DOUBLE) END AS gain FROM o WHERE episode >= 1),
 k AS (SELECT *, sum(log_keep) OVER ({_EPI} {_SO_FAR}) AS total FROM s),
 b AS (SELECT *, exp(total) * sum(gain * exp(-total)) OVER ({_EPI} {_SO_FAR}) AS basis FROM k),
 p AS (SELECT *, coalesce(lag(basis) OVER ({_EPI}), basis) AS before FROM b)
SELECT owner, mint, slot, txi, CAST(episode AS BIGINT) AS episode, {cut('basis', 3)} AS basis_after, CASE WHEN delta < 0 THEN {cut('px / before - 1', 5)} END AS realized_share, CASE WHEN delta < 0 THEN {cut('-delta * (px - before)', 2)} END AS realized FROM p"""
statement("avg_cost_basis_recursion", _BASIS)

# Folds by block n // 5 in time order, the last one longer; a fold's earlier calls leave it by the first rule they break: label, embargo, entity. Ranks come from counts by time, so no window holds all calls.
_FOLDS, _LABEL, _EMBARGO = 5, 86400 * 30, 86400 * 7
_WALK_FORWARD = f"""WITH n AS (SELECT count(*) AS n FROM calls),
 times AS (SELECT t, count(*) AS k FROM calls GROUP BY t), before AS (SELECT t, sum(k) OVER (ORDER BY t {_SO_FAR}) - k AS k FROM times),
 s AS (SELECT call_id, mint, c.t, CAST(k + row_number() OVER (PARTITION BY c.t ORDER BY call_id) - 1 AS BIGINT) AS place, n div {_FOLDS} AS size FROM calls c JOIN before b ON b.t = c.t, n WHERE n >= {_FOLDS}),
 x AS (SELECT *, least(place div size, {_FOLDS - 1}) AS block FROM s),
 e AS (SELECT block AS fold, min(t) AS start FROM x WHERE block > 0 GROUP BY block),
 m AS (SELECT DISTINCT block AS fold, mint FROM x WHERE block > 0),
 r AS (SELECT fold, CASE WHEN x.t + {_LABEL} >= start THEN 'label' WHEN x.t > start - {_EMBARGO} THEN 'embargo' WHEN m.mint IS NOT NULL THEN 'entity' ELSE 'train' END AS why FROM (SELECT x.*, e.fold, e.start FROM x JOIN e ON x.block < e.fold) x LEFT JOIN m USING (fold, mint))
SELECT fold, count(*) FILTER (WHERE why = 'train') AS train, count(*) FILTER (WHERE why = 'label') AS purged_by_label, count(*) FILTER (WHERE why = 'embargo') AS embargoed, count(*) FILTER (WHERE why = 'entity') AS purged_by_entity FROM r GROUP BY fold"""
_WALK_ORACLE = f"""WITH s AS (SELECT mint, t, row_number() OVER (ORDER BY t, call_id) - 1 AS place, count(*) OVER () // {_FOLDS} AS size FROM calls),
 f AS (SELECT fold, fold * max(size) AS first, CASE WHEN fold = {_FOLDS - 1} THEN count(*) ELSE (fold + 1) * max(size) END AS last FROM s, (VALUES (1), (2), (3), (4)) AS fs(fold) GROUP BY fold),
 e AS (SELECT f.*, (SELECT t FROM s WHERE place = f.first) AS start FROM f),
 r AS (SELECT fold, t + {_LABEL} >= start AS label, t > start - {_EMBARGO} AS embargo, EXISTS (SELECT 1 FROM s z WHERE z.mint = s.mint AND z.place >= e.first AND z.place < e.last) AS entity FROM e JOIN s ON s.place < e.first)
SELECT fold, count(*) FILTER (WHERE NOT label AND NOT embargo AND NOT entity) AS train, count(*) FILTER (WHERE label) AS purged_by_label, count(*) FILTER (WHERE NOT label AND embargo) AS embargoed, count(*) FILTER (WHERE NOT label AND NOT embargo AND entity) AS purged_by_entity FROM r GROUP BY fold"""
statement("walk_forward_split", _WALK_FORWARD, _WALK_ORACLE)

# Actions are line numbers; the target policy is a table, the reward model each action's mean reward in the first half of the tape.
_OPE = f"""WITH g AS (SELECT txi AS action, CAST(side AS DOUBLE) AS r, {{p}} AS propensity FROM trades), pi AS (SELECT action, CAST(p AS DOUBLE) AS p FROM (VALUES (1, 0.5), (2, 0.3), (3, 0.2)) AS v(action, p)),
 m AS (SELECT txi AS action, CAST(sum(side) AS DOUBLE) / count(*) AS r FROM trades WHERE d < 1250 GROUP BY txi), a AS (SELECT sum(pi.p * coalesce(m.r, 0)) AS direct FROM pi LEFT JOIN m USING (action)),
 w AS (SELECT coalesce(pi.p, 0) / g.propensity AS w, g.r, coalesce(m.r, 0) AS model FROM g LEFT JOIN pi USING (action) LEFT JOIN m USING (action))
SELECT {q('sum(w * r) / count(*)', 6)} AS ips, {q('CASE WHEN sum(w) > 0 THEN sum(w * r) / sum(w) ELSE 0 END', 6)} AS snips, {q('max(direct) + sum(w * (r - model)) / count(*)', 6)} AS doubly_robust, {q('sum(w) * sum(w) / nullif(sum(w * w), 0)', 2)} AS ess, {q('max(w)', 6)} AS max_weight, count(*) AS n FROM w, a"""
statement("off_policy_eval", _OPE.format(p="CAST(0.04 + 0.03 * txi AS DOUBLE)"))

# A call's outcome is measured on the mint's daily closes, and only where the tape reaches past the horizon. Base: the last close at or before the call, else the first within ten days after. Closes are joined as of each instant.
_DAY, _GRACE = 86400, 10
_SERIES = "k AS (SELECT mint, d, max_by(px, struct(slot, txi, owner, cents)) AS close FROM trades GROUP BY mint, d)"
_OUTCOMES = f"""WITH {_SERIES}, z AS (SELECT max(d) AS fetched FROM k), c AS (SELECT call_id, mint, t div {_DAY} AS d FROM calls),
 asks AS (SELECT call_id, mint, d + h AS d, h FROM c, (VALUES (0), (30), (90)) AS hs(h)),
 both_ AS (SELECT mint, d, 0 AS ask, close, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS INT) AS h FROM k UNION ALL SELECT mint, d, 1, NULL, call_id, h FROM asks),
 at AS (SELECT call_id, h, ask, last_value(close) IGNORE NULLS OVER (PARTITION BY mint ORDER BY d, ask {_SO_FAR}) AS close, first_value(CASE WHEN ask = 0 THEN d END) IGNORE NULLS OVER f AS next_d, first_value(close) IGNORE NULLS OVER f AS next_close, d FROM both_ WINDOW f AS (PARTITION BY mint ORDER BY d, ask ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 p AS (SELECT call_id, max(CASE WHEN h = 0 THEN coalesce(close, CASE WHEN next_d <= d + {_GRACE} THEN next_close END) END) AS base, max(CASE WHEN h = 30 THEN close END) AS c30, max(CASE WHEN h = 90 THEN close END) AS c90 FROM at WHERE ask = 1 GROUP BY call_id),
 i AS (SELECT c.call_id, k.d, k.close FROM (SELECT *, explode(sequence(d div 90, d div 90 + 1)) AS b FROM c) c JOIN (SELECT *, d div 90 AS b FROM k) k ON k.mint = c.mint AND k.b = c.b AND k.d >= c.d AND k.d <= c.d + 90),
 y AS (SELECT i.call_id, i.close, greatest(base, max(i.close) OVER (PARTITION BY i.call_id ORDER BY i.d {_SO_FAR})) AS peak, base FROM i JOIN p ON p.call_id = i.call_id WHERE base > 0),
 x AS (SELECT call_id, max(close) / max(base) AS multiple, max((peak - close) / peak) AS drawdown FROM y GROUP BY call_id),
 last_ AS (SELECT mint, max(d) AS d FROM k GROUP BY mint)
SELECT c.call_id, CASE WHEN fetched >= c.d + 30 AND base > 0 THEN c30 / base - 1 END AS return_30, CASE WHEN fetched >= c.d + 90 AND base > 0 THEN c90 / base - 1 END AS return_90, CASE WHEN fetched >= c.d + 90 THEN multiple END AS max_multiple, CASE WHEN fetched >= c.d + 90 THEN drawdown END AS drawdown, CASE WHEN fetched >= c.d + 90 AND last_.mint IS NOT NULL THEN last_.d <= c.d + 30 END AS dead
FROM c JOIN p ON p.call_id = c.call_id LEFT JOIN x ON x.call_id = c.call_id LEFT JOIN last_ ON last_.mint = c.mint, z"""
_OUTCOMES_ORACLE = f"""WITH {_SERIES}, z AS (SELECT max(d) AS fetched FROM k), c AS (SELECT call_id, mint, t // {_DAY} AS d FROM calls),
 p AS (SELECT c.*, coalesce((SELECT max_by(close, k.d) FROM k WHERE k.mint = c.mint AND k.d <= c.d), (SELECT min_by(close, k.d) FROM k WHERE k.mint = c.mint AND k.d > c.d AND k.d <= c.d + {_GRACE})) AS base,
  (SELECT max_by(close, k.d) FROM k WHERE k.mint = c.mint AND k.d <= c.d + 30) AS c30, (SELECT max_by(close, k.d) FROM k WHERE k.mint = c.mint AND k.d <= c.d + 90) AS c90, (SELECT max(k.d) FROM k WHERE k.mint = c.mint) AS last_d FROM c),
 y AS (SELECT p.call_id, k.close, p.base, greatest(p.base, (SELECT max(j.close) FROM k j WHERE j.mint = p.mint AND j.d BETWEEN p.d AND k.d)) AS peak FROM p JOIN k ON k.mint = p.mint AND k.d BETWEEN p.d AND p.d + 90 WHERE p.base > 0),
 x AS (SELECT call_id, max(close / base) AS multiple, max((peak - close) / peak) AS drawdown FROM y GROUP BY call_id)
SELECT p.call_id, CASE WHEN fetched >= p.d + 30 AND base > 0 THEN c30 / base - 1 END AS return_30, CASE WHEN fetched >= p.d + 90 AND base > 0 THEN c90 / base - 1 END AS return_90, CASE WHEN fetched >= p.d + 90 THEN multiple END AS max_multiple, CASE WHEN fetched >= p.d + 90 THEN drawdown END AS drawdown, CASE WHEN fetched >= p.d + 90 AND last_d IS NOT NULL THEN last_d <= p.d + 30 END AS dead
FROM p LEFT JOIN x ON x.call_id = p.call_id, z"""
statement("archive_outcomes", _OUTCOMES, _OUTCOMES_ORACLE)

# Strictly before each trade; an empty window gives 0.
_W = lambda days: f"OVER (PARTITION BY mint ORDER BY t RANGE BETWEEN {86400 * days} PRECEDING AND 1 PRECEDING)"
_RATIO = lambda days: f"CASE WHEN coalesce(sum(qty) {_W(days)}, 0) > 0 THEN CAST(sum(delta) {_W(days)} AS DOUBLE) / CAST(sum(qty) {_W(days)} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
statement(
    "order_flow_features",
    f"""SELECT mint, slot, txi, owner, {_RATIO(30)} AS ofi_30, {_RATIO(300)} AS ofi_300, CAST(coalesce(sum(delta) {_W(30)}, 0) AS BIGINT) AS signed_30, count(*) {_W(30)} AS n_30,
 {q(f'ln((CAST(count(*) {_W(30)} AS DOUBLE) / 30 + 0.001) / (CAST(count(*) {_W(300)} AS DOUBLE) / 300 + 0.001))', 7)} AS acceleration, CASE WHEN max(qty) {_W(30)} > 2 * avg(CAST(qty AS DOUBLE)) {_W(300)} THEN 1 ELSE 0 END AS big_trade FROM trades""",
)


def shadow_policy_arena(h) -> str:
    """Three policies branch over each sale and sell all, half or a drawn share of the units that FIFO matched; a branch bears the share of the sale's cost basis that its units are of the matched ones."""
    share = h("concat('arena', CAST(slot AS STRING), '-', CAST(txi AS STRING))")
    return f"""{_FIFO.split("SELECT c.owner, c.mint")[0].rstrip()}, s AS (SELECT c.owner, c.slot, c.txi, cents, qty, matched, cost.cost FROM c JOIN cost ON cost.owner = c.owner AND cost.mint = c.mint AND cost.slot = c.slot AND cost.txi = c.txi WHERE c.side = -1 AND matched > 0),
 b AS (SELECT owner, policy, CASE policy WHEN 'all' THEN matched WHEN 'half' THEN matched div 2 ELSE {share} % (matched + 1) END AS units, cents, qty, matched, cost FROM s, (VALUES ('all'), ('half'), ('drawn')) AS p(policy))
SELECT owner, policy, CAST(sum(units) AS BIGINT) AS units, {q('sum(CAST(units AS DOUBLE) * cents / qty)', 2)} AS proceeds_cents, {q('sum(CAST(units AS DOUBLE) * cost / matched)', 2)} AS basis_cents FROM b GROUP BY owner, policy"""


resampled("shadow_policy_arena", shadow_policy_arena)
