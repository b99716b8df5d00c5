"""Bootstraps, permutations and null models.

Draws are hashes of replicate and entity, so that a task run again gives the same rows and
both engines draw alike. Entities are resampled by Poisson counts of mean 1 instead of by
n numbered draws: no replicate needs a number for each entity, and every replicate is one
aggregate over data that was aggregated by entity before.
"""

from tidemark.operators.sql import poisson, q, resampled

REPLICATES = 40
_B = f"explode(sequence(0, {REPLICATES - 1}))"
_LO, _HI = int(0.025 * (REPLICATES - 1)), int(0.975 * (REPLICATES - 1))


def _drawn(h, what: str, entity: str = "entity", salt: str = "w") -> str:
    """what (columns of table c) with replicate b and how often it takes the entity, above 0."""
    u = h(f"concat('{salt}', CAST(b AS STRING), '-', CAST({entity} AS STRING))")
    return f"g AS (SELECT {what}, {_B} AS b FROM c), v AS (SELECT *, {u} AS u FROM g), w AS (SELECT * FROM (SELECT *, {poisson('u')} AS w FROM v) x WHERE w > 0)"


def entity_bootstrap(h) -> str:
    """Interval of the cumulative incidence of one cause by landmark, over replicates of entities."""
    return f"""WITH r AS (SELECT o_custkey AS entity, o_orderkey % 60 + 1 AS time_to, CASE o_orderstatus WHEN 'F' THEN 'died' WHEN 'P' THEN 'moved' END AS mode FROM orders),
 c AS (SELECT entity, time_to, count(*) AS n, count(mode) AS d, count(*) FILTER (WHERE mode = 'died') AS d1 FROM r GROUP BY entity, time_to),
 {_drawn(h, 'entity, time_to, n, d, d1')},
 t AS (SELECT b, time_to, CAST(sum(n * w) AS BIGINT) AS n, CAST(sum(d * w) AS BIGINT) AS d, CAST(sum(d1 * w) AS BIGINT) AS d1 FROM w GROUP BY b, time_to),
 k AS (SELECT b, time_to, d, d1, sum(n) OVER (PARTITION BY b ORDER BY time_to DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM t),
 s AS (SELECT b, time_to, d1, at_risk, exp(sum(ln(CASE WHEN d < at_risk THEN 1 - CAST(d AS DOUBLE) / at_risk ELSE 1e-300 END)) OVER (PARTITION BY b ORDER BY time_to ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS surv FROM k),
 i AS (SELECT b, time_to, CAST(d1 AS DOUBLE) / at_risk * coalesce(lag(surv) OVER (PARTITION BY b ORDER BY time_to), 1) AS step FROM s),
 f AS (SELECT b, grid, sum(step) AS cif FROM i JOIN (VALUES (10), (30), (60)) AS gs(grid) ON time_to <= grid GROUP BY b, grid),
 o AS (SELECT grid, cif, row_number() OVER (PARTITION BY grid ORDER BY cif) - 1 AS rn FROM f)
SELECT grid, {q(f'max(CASE WHEN rn = {_LO} THEN cif END)', 7)} AS lo, {q(f'max(CASE WHEN rn = {_HI} THEN cif END)', 7)} AS hi FROM o GROUP BY grid"""


def cluster_bootstrap_auc(h) -> str:
    """Interval of the AUC of a score, over replicates of clusters; tied scores count half."""
    return f"""WITH c AS (SELECT o_custkey AS entity, CAST(floor(o_totalprice / 1000) AS BIGINT) AS score, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos, count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1, 2),
 {_drawn(h, 'entity, score, pos, neg', salt='auc')},
 t AS (SELECT b, score, CAST(sum(pos * w) AS BIGINT) AS p, CAST(sum(neg * w) AS BIGINT) AS n FROM w GROUP BY b, score),
 r AS (SELECT b, p, n, sum(n) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM t),
 a AS (SELECT b, CAST(sum(p * (2 * below - n)) AS DOUBLE) / (2 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM r GROUP BY b HAVING sum(p) > 0 AND sum(n) > 0)
SELECT {q('percentile(auc, 0.025)', 7)} AS lo, {q('percentile(auc, 0.975)', 7)} AS hi, count(*) AS draws FROM a"""


def risk_ratio_bootstrap(h) -> str:
    """Share of purchases among discounted trades over that among the others, with its interval over replicates of owners."""
    return f"""WITH c AS (SELECT owner AS entity, count(*) FILTER (WHERE discount > 0.05 AND side = 1) AS a, count(*) FILTER (WHERE discount > 0.05) AS n, count(*) FILTER (WHERE discount <= 0.05 AND side = 1) AS z, count(*) FILTER (WHERE discount <= 0.05) AS m FROM trades GROUP BY owner),
 {_drawn(h, 'entity, a, n, z, m', salt='rr')},
 t AS (SELECT b, CAST(sum(a * w) AS DOUBLE) / nullif(sum(n * w), 0) / nullif(CAST(sum(z * w) AS DOUBLE) / nullif(sum(m * w), 0), 0) AS rr FROM w GROUP BY b),
 o AS (SELECT CAST(sum(a) AS DOUBLE) / nullif(sum(n), 0) / nullif(CAST(sum(z) AS DOUBLE) / nullif(sum(m), 0), 0) AS rr FROM c)
SELECT {q('max(o.rr)', 7)} AS risk_ratio, {q('percentile(t.rr, 0.025)', 7)} AS lo, {q('percentile(t.rr, 0.975)', 7)} AS hi FROM t, o"""


#: The days of the tape: few rows however long the tape, so a window over all of them is one small task.
_DAYS = "s AS (SELECT d, CAST(sum(delta) AS BIGINT) AS x, count(*) AS y, row_number() OVER (ORDER BY d) - 1 AS rn, count(*) OVER () AS n FROM trades GROUP BY d)"


def block_permute(h, block: int = 20) -> str:
    """The daily flow in circular blocks of 20 days from drawn starts."""
    start = h(f"concat('block', CAST(rn div {block} AS STRING))")
    return f"""WITH {_DAYS}, p AS (SELECT rn, n, ({start} + rn % {block}) % n AS source FROM s)
SELECT p.rn, s.d AS from_d, s.x FROM p JOIN s ON s.rn = p.source"""


def rotation_null(h) -> str:
    """Correlation of the day's flow and activity against that under every rotation of one of them, and its p value."""
    return f"""WITH {_DAYS}, k AS (SELECT explode(sequence(CAST(0 AS BIGINT), n - 1)) AS shift FROM (SELECT max(n) AS n FROM s) z WHERE n > 2),
 r AS (SELECT shift, {q('corr(CAST(a.x AS DOUBLE), CAST(b.y AS DOUBLE))', 9)} AS r FROM s a CROSS JOIN k JOIN s b ON b.rn = (a.rn + shift) % a.n GROUP BY shift)
SELECT max(CASE WHEN shift = 0 THEN r END) AS observed, count(*) - 1 AS rotations, CAST(1 + count(*) FILTER (WHERE shift > 0 AND abs(r) >= abs(o)) AS DOUBLE) / count(*) AS p FROM (SELECT shift, r, max(CASE WHEN shift = 0 THEN r END) OVER () AS o FROM r) x"""


def _midranks(table: str, key: str, value: str, part: str) -> str:
    return f"(SELECT {key}, {part}, rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / CAST(2 AS DOUBLE) AS r FROM {table})"


def spearman_permutation(h, draws: int = 99) -> str:
    """Spearman correlation of volume and owners of the mints of a brand, and its two-sided p value over permutations inside the brand."""
    return f"""WITH m AS (SELECT mint, CAST(sum(qty) AS BIGINT) AS x, count(DISTINCT owner) AS y FROM trades GROUP BY mint),
 c AS (SELECT mint, x, y, p_brand AS brand FROM m JOIN part ON p_partkey = mint),
 rx AS {_midranks('c', 'mint', 'x', 'brand')}, ry AS {_midranks('c', 'mint', 'y', 'brand')},
 o AS (SELECT rx.brand, rx.mint, rx.r AS rx, ry.r AS ry, row_number() OVER (PARTITION BY rx.brand ORDER BY rx.mint) AS rn FROM rx JOIN ry ON rx.mint = ry.mint JOIN (SELECT brand FROM c GROUP BY brand HAVING min(x) < max(x) AND min(y) < max(y)) v ON v.brand = rx.brand),
 g AS (SELECT brand, mint, ry, explode(sequence(1, {draws})) AS b FROM o),
 p AS (SELECT brand, b, ry, row_number() OVER (PARTITION BY brand, b ORDER BY {h("concat('rho', CAST(b AS STRING), '-', CAST(mint AS STRING))")}, mint) AS rn FROM g),
 d AS (SELECT o.brand, p.b, {q('corr(o.rx, p.ry)', 9)} AS rho FROM o JOIN p ON p.brand = o.brand AND p.rn = o.rn GROUP BY o.brand, p.b),
 s AS (SELECT brand, {q('corr(rx, ry)', 9)} AS rho, count(*) AS n FROM o GROUP BY brand)
SELECT s.brand, s.n, s.rho, CAST(1 + count(*) FILTER (WHERE abs(d.rho) >= abs(s.rho)) AS DOUBLE) / (1 + count(*)) AS p FROM s JOIN d ON d.brand = s.brand GROUP BY s.brand, s.n, s.rho"""


def stratified_discrimination(h, draws: int = 99) -> str:
    """Difference of mean quantities of discounted and other trades inside strata, weighed by their sizes, and its p value over permutations of owners' labels."""
    label = lambda b: h(f"concat('disc', {b}, '-', CAST(owner AS STRING))") + " % 2"
    effect = lambda on: f"sum(n * (CAST(sum_a AS DOUBLE) / nullif(n_a, 0) - CAST(sum_z AS DOUBLE) / nullif(n_z, 0))) / sum(n)"  # noqa: E731, ARG005
    sums = lambda on: f"count(*) AS rows_, CAST(sum(k) AS BIGINT) AS n, CAST(sum(CASE WHEN {on} THEN k END) AS BIGINT) AS n_a, CAST(sum(CASE WHEN {on} THEN s END) AS BIGINT) AS sum_a, CAST(sum(CASE WHEN NOT ({on}) THEN k END) AS BIGINT) AS n_z, CAST(sum(CASE WHEN NOT ({on}) THEN s END) AS BIGINT) AS sum_z"
    return f"""WITH c AS (SELECT p_brand AS stratum, owner, discount > 0.05 AS a, count(*) AS k, CAST(sum(qty) AS BIGINT) AS s FROM trades JOIN part ON p_partkey = mint GROUP BY 1, 2, 3),
 o AS (SELECT {effect('a')} AS effect FROM (SELECT stratum, {sums('a')} FROM c GROUP BY stratum) x WHERE n_a > 0 AND n_z > 0),
 g AS (SELECT stratum, owner, a, k, s, explode(sequence(1, {draws})) AS b FROM c),
 l AS (SELECT stratum, b, k, s, CASE WHEN {label('CAST(b AS STRING)')} = 1 THEN a ELSE NOT a END AS a FROM g),
 d AS (SELECT b, {effect('a')} AS effect FROM (SELECT b, stratum, {sums('a')} FROM l GROUP BY b, stratum) x WHERE n_a > 0 AND n_z > 0 GROUP BY b)
SELECT {q('max(o.effect)', 7)} AS effect, CAST(1 + count(*) FILTER (WHERE abs(d.effect) >= abs(o.effect) - 1e-12) AS DOUBLE) / (1 + count(*)) AS p FROM d, o"""


def placebo_windows(h, days: int = 14, pre: int = 1, post: int = 3) -> str:
    """For each call up to two placebo days of the same mint and time of day, drawn from a fortnight each way, at least max(pre, post) days from every call of the mint and inside the tape; a call may get fewer."""
    far = max(pre, post)
    return f"""WITH c AS (SELECT call_id, mint, t div 86400 AS d, t % 86400 AS s FROM calls), e AS (SELECT min(d) + {pre} AS lo, max(d) - {post} AS hi FROM c),
 g AS (SELECT call_id, mint, d, s, explode(sequence({-days}, {days})) AS k FROM c),
 p AS (SELECT call_id, mint, d + k AS d, s FROM g, e WHERE k <> 0 AND d + k BETWEEN lo AND hi),
 near AS (SELECT mint, d + k AS d FROM (SELECT mint, d, explode(sequence({1 - far}, {far - 1})) AS k FROM c) x GROUP BY 1, 2),
 o AS (SELECT p.call_id, p.d, p.s, row_number() OVER (PARTITION BY p.call_id ORDER BY {h("concat('placebo', CAST(p.call_id AS STRING), '-', CAST(p.d AS STRING))")}, p.d) AS replicate FROM p LEFT JOIN near ON near.mint = p.mint AND near.d = p.d WHERE near.d IS NULL)
SELECT call_id, replicate, d * 86400 + s AS t FROM o WHERE replicate <= 2"""


def burst_null(h, window: int = 20, bandwidth: int = 60, draws: int = 19) -> str:
    """Pairs of a mint's trades of other owners within 20 days, against draws in which every trade moves by at most the bandwidth (the coarse profile and each owner's count stay) and draws that are uniform over the mint's span; p of each. Pairs meet by buckets of the window's width."""
    jitter = h("concat('env', CAST(b AS STRING), '-', CAST(slot AS STRING), '-', CAST(txi AS STRING), '-', CAST(owner AS STRING))")
    uniform = h("concat('uni', CAST(b AS STRING), '-', CAST(slot AS STRING), '-', CAST(txi AS STRING), '-', CAST(owner AS STRING))")
    near = f"""SELECT {{key}}, sum(CASE WHEN y.d - x.d <= {window} AND (y.d > x.d OR y.d = x.d AND y.owner > x.owner) THEN x.k * y.k ELSE 0 END) AS pairs FROM (SELECT *, d div {window} AS at FROM {{t}}) x JOIN (SELECT *, explode(sequence(d div {window} - 1, d div {window})) AS at FROM {{t}}) y ON y.at = x.at AND y.mint = x.mint AND y.kind = x.kind AND y.b = x.b AND y.owner <> x.owner GROUP BY {{key}}"""
    return f"""WITH a AS (SELECT mint, slot, txi, owner, d, min(d) OVER (PARTITION BY mint) AS lo, max(d) OVER (PARTITION BY mint) AS hi FROM trades),
 g AS (SELECT *, explode(sequence(1, {draws})) AS b FROM a WHERE hi > lo),
 s AS (SELECT mint, 'observed' AS kind, 0 AS b, owner, d FROM a WHERE hi > lo
  UNION ALL SELECT mint, 'envelope', b, owner, greatest(d + {jitter} % {2 * bandwidth + 1} - {bandwidth}, 0) FROM g
  UNION ALL SELECT mint, 'uniform', b, owner, lo + {uniform} % (hi - lo + 1) FROM g),
 k AS (SELECT mint, kind, b, owner, d, count(*) AS k FROM s GROUP BY mint, kind, b, owner, d),
 n AS ({near.format(t='k', key='x.mint, x.kind, x.b')}),
 z AS (SELECT kind, b, CAST(sum(pairs) AS BIGINT) AS pairs FROM n GROUP BY kind, b)
SELECT z.kind, CAST(max(o.pairs) AS BIGINT) AS observed, {q('avg(CAST(z.pairs AS DOUBLE))', 4)} AS mean, CAST(1 + count(*) FILTER (WHERE z.pairs >= o.pairs) AS DOUBLE) / (1 + count(*)) AS p FROM z, (SELECT pairs FROM z WHERE kind = 'observed') o WHERE z.kind <> 'observed' GROUP BY z.kind"""


def _curveball(h, rounds: int, salt: str, end: str = "") -> str:
    """Tables a0..a<rounds> of (owner, mint), their names ending in end: each round pairs owners at random inside hash buckets of about 32, and each pair deals out anew the mints that only one of them has."""
    text = f"a0{end} AS (SELECT DISTINCT owner, mint FROM trades)"
    for i in range(rounds):
        draw = h(f"concat('{salt}{i}-', CAST(owner AS STRING))")
        deal = h(f"concat('{salt}{i}-', CAST(pair AS STRING), '-', CAST(mint AS STRING))")
        at = f"{i}{end}"
        text += f""",
 p{at} AS (SELECT owner, bucket * 1000000 + (row_number() OVER (PARTITION BY bucket ORDER BY u, owner) - 1) div 2 AS pair FROM (SELECT owner, {draw} AS u, {draw} % (SELECT 1 + count(DISTINCT owner) div 32 FROM a0{end}) AS bucket FROM (SELECT DISTINCT owner FROM a0{end}) z) y),
 e{at} AS (SELECT a.owner, a.mint, pair, count(*) OVER (PARTITION BY pair, mint) AS holders, min(a.owner) OVER (PARTITION BY pair) AS low, max(a.owner) OVER (PARTITION BY pair) AS high FROM a{at} a JOIN p{at} p ON p.owner = a.owner),
 d{at} AS (SELECT mint, low, high, sum(CASE WHEN owner = low THEN 1 ELSE 0 END) OVER (PARTITION BY pair) AS quota, row_number() OVER (PARTITION BY pair ORDER BY {deal}, mint) AS place FROM e{at} WHERE holders = 1),
 a{i + 1}{end} AS (SELECT owner, mint FROM e{at} WHERE holders = 2 UNION ALL SELECT CASE WHEN place <= quota THEN low ELSE high END, mint FROM d{at})"""
    return text


def curveball_null(h, rounds: int = 3) -> str:
    """The owners' mints after rounds of trades that keep every owner's and every mint's degree."""
    return f"WITH {_curveball(h, rounds, 'curve')} SELECT owner, mint FROM a{rounds}"


def against_null(h, draws: int = 3, rounds: int = 2) -> str:
    """Largest overlap of owners of neighbouring numbers, and their mean overlap, against draws of the degree-preserving null."""
    statistic = lambda t: f"(SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS top FROM (SELECT x.owner, count(*) AS n FROM {t} x JOIN {t} y ON y.mint = x.mint AND y.owner = x.owner + 1 GROUP BY x.owner) z)"
    tables = ", ".join(_curveball(h, rounds, f"draw{i}", f"_{i}") for i in range(draws))
    union = " UNION ALL ".join(f"SELECT {i} AS draw, total, top FROM {statistic(f'a{rounds}_{i}')} s" for i in range(draws))
    return f"WITH {tables}, o AS (SELECT total, top FROM {statistic('a0_0')} s), n AS ({union}) SELECT max(o.total) AS observed, {q('avg(CAST(n.total AS DOUBLE))', 4)} AS expected, max(o.top) AS observed_top, CAST(1 + count(*) FILTER (WHERE n.total >= o.total) AS DOUBLE) / (1 + count(*)) AS p FROM n, o"


for _f in (entity_bootstrap, cluster_bootstrap_auc, risk_ratio_bootstrap, block_permute, rotation_null, spearman_permutation, stratified_discrimination, placebo_windows, burst_null, curveball_null, against_null):
    resampled(_f.__name__, _f)


def regime_tag(h, draws: int = 20, block: int = 6) -> str:
    """Slope of a mint's signature curve from lag 1 to lag 4, with its interval over replicates of blocks of 6 events, and a label; a mint of few events is refused."""
    u = h("concat('regime', CAST(b AS STRING), '-', CAST(mint AS STRING), '-', CAST(block AS STRING))")
    slope = "CASE WHEN {a} > 0 AND {b} > 0 THEN ln({b} / {m} / 4 / ({a} / {n})) / ln(CAST(4 AS DOUBLE)) END"
    return f"""WITH e AS (SELECT mint, ln(px) AS l, row_number() OVER w AS rn, ln(px) - lag(ln(px), 1) OVER w AS r1, ln(px) - lag(ln(px), 4) OVER w AS r4 FROM trades WINDOW w AS (PARTITION BY mint ORDER BY d, slot, txi, owner, cents)),
 c AS (SELECT mint, (rn - 1) div {block} AS block, count(*) AS n, sum(r1 * r1) AS s1, count(r1) AS n1, coalesce(sum(r4 * r4), 0) AS s4, count(r4) AS n4 FROM e GROUP BY 1, 2),
 o AS (SELECT mint, CAST(sum(n) AS BIGINT) AS n, {slope.format(a='sum(s1)', b='sum(s4)', n='sum(n1)', m='sum(n4)')} AS slope FROM c GROUP BY mint),
 g AS (SELECT mint, block, s1, n1, s4, n4, explode(sequence(1, {draws})) AS b FROM c), v AS (SELECT *, {u} AS u FROM g), w AS (SELECT *, {poisson('u')} AS w FROM v),
 t AS (SELECT mint, b, sum(w * s1) AS s1, sum(w * n1) AS n1, sum(w * s4) AS s4, sum(w * n4) AS n4 FROM w GROUP BY mint, b), r AS (SELECT mint, {slope.format(a='s1', b='s4', n='n1', m='n4')} AS slope FROM t WHERE n1 > 0 AND n4 > 0),
 i AS (SELECT mint, percentile(slope, 0.1) AS lo, percentile(slope, 0.9) AS hi FROM r GROUP BY mint)
SELECT o.mint, o.n, CASE WHEN o.n >= 16 THEN {q('o.slope', 5)} END AS slope, CASE WHEN o.n < 16 THEN 'too_few_events' WHEN o.slope IS NULL OR lo IS NULL THEN 'no_variance' WHEN hi < 0 THEN 'reverting' WHEN lo > 0 THEN 'trending' ELSE 'undecided' END AS label FROM o LEFT JOIN i ON i.mint = o.mint"""


resampled("regime_tag", regime_tag)
