"""Learning as the tape goes on: policies, a point process, orders against recorded reserves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import hawkes
from tidemark.functions.bandits import Desk, Desks
from tidemark.functions.folds import folded, folded_together
from tidemark.functions.pool import DipPolicy, Replay
from tidemark.operators.registry import query
from tidemark.operators.sql import run
from tidemark.plans.tape import oracle

#: Later trades of the mint at which an arm sells.
EXITS = (1, 2, 5)
CONTEXT = ["one", "discount", "tax", "log_qty", "side"]
_LEADS = ", ".join(f"lead(px, {k}) OVER w AS p{i}, lead(t, {k}) OVER w AS t{i}" for i, k in enumerate(EXITS))
_ROUNDS = f"""SELECT owner, t, slot, txi, 1.0D AS one, discount, tax, ln(qty + 1) AS log_qty, CAST(side AS DOUBLE) AS side,
 {", ".join(f"ln(p{i} / px) AS reward{i}, CAST(t{i} - t AS DOUBLE) AS delay{i}" for i in range(len(EXITS)))}
FROM (SELECT *, {_LEADS} FROM trades WINDOW w AS (PARTITION BY mint ORDER BY t, slot, txi, owner)) x WHERE p{len(EXITS) - 1} IS NOT NULL"""


@query("contextual_bandit")
def contextual_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each owner's desk three policies (epsilon-greedy, upper bounds, drawn weights) over when to sell what it traded; a reward teaches once the exit has happened. Rounds, rewards learned by the end, the sum of rewards, and that of the best single exit."""
    rows = run(spark, sf_dir, _ROUNDS)
    return folded_together(rows, "owner", ["t", "slot", "txi"], lambda key: Desk(key, len(EXITS), CONTEXT), Desks(len(EXITS), CONTEXT).results, "owner long, policy string, rounds long, updates long, reward double, best_alone double")


@query("hawkes_bivariate")
def hawkes_bivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys and sells of all mints as one process that excites itself, time in days: base rates, branching, decay, the branching ratio and the log likelihood."""
    found, value, n, sequences = hawkes.fit(run(spark, sf_dir, "SELECT mint, t / 86400.0D AS days, CASE WHEN side = -1 THEN 1 ELSE 0 END AS sell FROM trades"), "mint", "days", "sell")
    bb, bs, sb, ss = (found[k] for k in hawkes.NAMES[2:6])
    ratio = ((bb + ss) + ((bb - ss) ** 2 + 4 * bs * sb) ** 0.5) / 2
    rows = [*found.items(), ("branching_ratio", ratio), ("log_likelihood", value), ("events", float(n)), ("sequences", float(sequences))]
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in rows], "parameter string, value double")


#: What a replay may take of a pool (of 10,000), its money (cents) and its wants (of the traded quantity).
PARTICIPATION, MONEY, WANTS = 200, 5_000_000, 60
_READINGS = f"""SELECT mint, d, slot, txi, qty * {WANTS} AS wanted,
 CAST(greatest(sum(-delta) OVER w + 100000, 1) AS BIGINT) AS tokens, CAST(greatest(sum(cents * side) OVER w + 200000000, 1) AS BIGINT) AS money
FROM trades WINDOW w AS (PARTITION BY mint ORDER BY d, slot, txi, owner, cents ROWS UNBOUNDED PRECEDING)"""
_REPLAYED = f"""WITH RECURSIVE r AS ({_READINGS}),
 s AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY d, slot, txi) AS n, CAST(CAST(money AS HUGEINT) * 1000000 // tokens AS BIGINT) AS price FROM r),
 o AS (SELECT *, lag(price) OVER (PARTITION BY mint ORDER BY n) AS before FROM s),
 step AS (
  SELECT mint, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS entry, CAST(0 AS BIGINT) AS since, CAST({MONEY} AS BIGINT) AS cash,
   CAST(0 AS BIGINT) AS fills, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS received, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS too_large FROM (SELECT DISTINCT mint FROM r) m
  UNION ALL
  SELECT mint, n, CASE WHEN bought THEN amount WHEN sold THEN 0 ELSE held END, CASE WHEN bought THEN price ELSE entry END, CASE WHEN bought THEN n ELSE since END,
   cash - CASE WHEN bought THEN cost ELSE 0 END + CASE WHEN sold THEN paid ELSE 0 END, fills + CASE WHEN bought OR sold THEN 1 ELSE 0 END,
   spent + CASE WHEN bought THEN cost ELSE 0 END, received + CASE WHEN sold THEN paid ELSE 0 END, refused + CASE WHEN buys AND NOT large AND NOT bought THEN 1 ELSE 0 END, too_large + CASE WHEN large THEN 1 ELSE 0 END
  FROM (SELECT *, buys AND NOT large AND amount < tokens AND cost <= cash AS bought, sells AND NOT large AS sold FROM (
   SELECT *, (buys OR sells) AND amount > tokens * {PARTICIPATION} // 10000 AS large,
    CASE WHEN amount < tokens THEN CAST((CAST(money AS HUGEINT) * amount + (tokens - amount) - 1) // (tokens - amount) AS BIGINT) END AS cost,
    CAST(CAST(money AS HUGEINT) * amount // (tokens + amount) AS BIGINT) AS paid FROM (
    SELECT *, CASE WHEN held > 0 THEN held ELSE wanted END AS amount FROM (
     SELECT o.mint, o.n, o.tokens, o.money, o.price, o.wanted, p.held, p.entry, p.since, p.cash, p.fills, p.spent, p.received, p.refused, p.too_large,
      p.held = 0 AND coalesce(o.price * 100 <= o.before * 97, false) AS buys, p.held > 0 AND (o.price * 100 >= p.entry * 103 OR o.n - p.since >= 5) AS sells
     FROM step p JOIN o ON o.mint = p.mint AND o.n = p.n + 1) a) b) c) e)
SELECT mint, n AS slots, fills, spent, received, cash, held, refused, too_large FROM step QUALIFY row_number() OVER (PARTITION BY mint ORDER BY n DESC) = 1"""


@query("event_replay", oracle(_REPLAYED))
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy that buys dips, replayed over each mint's trades against the reserves that they leave: fills in whole units, orders above 2 % of the pool refused. Realised money only; nothing is marked."""
    rows = run(spark, sf_dir, _READINGS)
    return folded(rows, "mint", ["d", "slot", "txi"], lambda key: Replay(key, MONEY, PARTICIPATION, DipPolicy()), "mint long, slots long, fills long, spent long, received long, cash long, held long, refused long, too_large long")
