"""Operators over evidence: digests and manifests, exact tests, calls with their outcomes, survival from measured exits, scores from history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.graph import hop_levels
from tidemark.operators.accounts import _FIFO, _FIFO_PAIRS
from tidemark.operators.market import _POSITIONS, _POSITIONS_PAIRS, _RULES
from tidemark.operators.registry import query
from tidemark.operators.sql import cut, q, resampled, run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.code import ship
from tidemark.sources.files import through
from tidemark.streaming.jobs import finished

_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


# --- digests: order-free sums of row hashes, so a table of any size is one aggregate --------------------------------

_TABLES = {
    "orders": ("o_orderkey", "concat_ws('|', CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING), o_orderstatus, o_orderpriority)"),
    "customer": ("c_custkey", "concat_ws('|', CAST(c_custkey AS STRING), c_name, CAST(c_nationkey AS STRING), c_mktsegment)"),
    "part": ("p_partkey", "concat_ws('|', CAST(p_partkey AS STRING), p_name, p_brand, p_type, CAST(p_size AS STRING))"),
    "nation": ("n_nationkey", "concat_ws('|', CAST(n_nationkey AS STRING), n_name, CAST(n_regionkey AS STRING))"),
}


def _manifest(h, drop: str = "") -> str:
    """Of each table (the named one without its first key, as if a row were lost): rows, distinct and null keys, and a digest of all rows."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_, count(*) AS rows_, count(*) - count(DISTINCT {k}) AS duplicate_keys, CAST(sum({h(line)}) AS BIGINT) AS digest FROM {t}{f' WHERE {k} > (SELECT min({k}) FROM {t})' if t == drop else ''}" for t, (k, line) in _TABLES.items())


resampled("snapshot_manifest_make", _manifest)
resampled("snapshot_manifest_load", lambda h: f"WITH m AS ({_manifest(h)}), f AS ({_manifest(h, 'part')}) SELECT m.table_, f.rows_ AS found_rows, CASE WHEN f.rows_ <> m.rows_ THEN 'row_count' WHEN f.digest <> m.digest THEN 'digest' WHEN f.duplicate_keys > 0 THEN 'duplicate_key' ELSE 'ok' END AS status FROM m JOIN f ON f.table_ = m.table_")
resampled("logical_table_digest", lambda h: f"SELECT count(*) AS rows_, CAST(sum({h('concat_ws(chr(124), CAST(slot AS STRING), CAST(txi AS STRING), CAST(mint AS STRING), CAST(owner AS STRING), CAST(cents AS STRING))')}) AS BIGINT) AS digest FROM trades")
# Numbers stand for one another, whatever they are and however long.
statement("digit_fold_content_hash", "SELECT doc_id, sha2(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '#'), 256) AS content_hash FROM documents", "SELECT doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '#', 'g')) AS content_hash FROM documents")
# Exactly 100 rows, the least by a hash of the key: the same ones however the table is dealt.
resampled("row_sample", lambda h: f"SELECT c_custkey FROM (SELECT c_custkey, {h('CAST(c_custkey AS STRING)')} AS u FROM customer ORDER BY u, c_custkey LIMIT 100) x")
statement("any_value", "SELECT l.owner, any_value(s_nationkey) AS nation, any_value(s_name) AS name, count(*) AS n FROM trades l JOIN supplier ON s_suppkey = owner GROUP BY l.owner")
# The second page starts after the last row of the first.
statement("keyset_pagination", "WITH f AS (SELECT event_id, t FROM ev ORDER BY t DESC, event_id DESC LIMIT 50), c AS (SELECT min(struct(t, event_id)) AS at FROM f) SELECT event_id, ev.t FROM ev, c WHERE struct(ev.t, event_id) < c.at ORDER BY ev.t DESC, event_id DESC LIMIT 50", "SELECT event_id, t FROM ev ORDER BY t DESC, event_id DESC LIMIT 50 OFFSET 50")


@query("jsonl_tail", "SELECT event_id % 100 = 7 AS torn, count(*) AS n, coalesce(sum(CASE WHEN event_id % 100 <> 7 THEN user_id END), 0) AS users FROM events GROUP BY 1")
def jsonl_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines followed as a stream, a file at a time; offsets are the stream's checkpoint, torn lines are kept apart."""
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = through(rows.select(F.when(F.col("event_id") % 100 == 7, F.substring(line, 1, 14)).otherwise(line).alias("value")).repartition(4), "text", "tail-source")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", 1).json(at)
    read = finished(stream.select(F.col("_corrupt").isNotNull().alias("torn"), "user_id"), "tail")
    return read.groupBy("torn").agg(F.count("*").alias("n"), F.coalesce(F.sum("user_id"), F.lit(0)).cast("long").alias("users"))


# --- exact tests on counts that Spark has made ----------------------------------------------------------------------

_COUNTS = "SELECT mint, count(*) FILTER (WHERE side = 1 AND d >= 1200) AS a, count(*) FILTER (WHERE side = -1 AND d >= 1200) AS b, count(*) FILTER (WHERE side = 1 AND d < 1200) AS c, count(*) FILTER (WHERE side = -1 AND d < 1200) AS d_ FROM trades GROUP BY mint"


def _by_counts(name: str, text: str, key: str, f, columns: dict[str, str], sql: str | None = None) -> None:
    @query(name, sql)
    def g(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame([(k, *f(*map(int, row))) for k, *row in x.itertuples(index=False)], columns=[key, *columns])

        return run(spark, sf_dir, text).mapInPandas(each, f"{key} long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


_LOG_CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_FISHER = f"""WITH c AS ({_COUNTS}), x AS (SELECT *, a + b AS r, c + d_ AS s, a + c AS k FROM c), e AS (SELECT *, unnest(range(greatest(0, k - s), least(k, r) + 1)) AS i FROM x),
 p AS (SELECT mint, i, a, {_LOG_CHOOSE.format(n='r', k='i')} + {_LOG_CHOOSE.format(n='s', k='(k - i)')} - {_LOG_CHOOSE.format(n='(r + s)', k='k')} AS lp FROM e), o AS (SELECT mint, lp FROM p WHERE i = a)
SELECT p.mint, round(least(1, sum(CASE WHEN p.lp <= o.lp + 1e-7 THEN exp(p.lp) ELSE 0 END)), 7) AS p FROM p JOIN o ON o.mint = p.mint GROUP BY p.mint"""
_by_counts("fisher_exact", _COUNTS, "mint", lambda a, b, c, d: (round(kernels.fisher_exact(a, b, c, d), 7),), {"p": "double"}, oracle(_FISHER))
_by_counts("clopper_pearson", "SELECT mint, count(*) FILTER (WHERE side = 1) AS k, count(*) AS n FROM trades GROUP BY mint", "mint", lambda k, n: kernels.clopper_pearson(k, n), {"lo": "double", "hi": "double"})
_SIGNS = "SELECT owner, count(*) FILTER (WHERE delta > 0) AS positive, count(*) FILTER (WHERE delta < 0) AS negative FROM trades GROUP BY owner"
_SIGN = f"""WITH c AS ({_SIGNS}), e AS (SELECT *, positive + negative AS n, unnest(range(0, least(positive, negative) + 1)) AS i FROM c)
SELECT owner, positive, negative, round(least(1, 2 * sum(exp({_LOG_CHOOSE.format(n='n', k='i')} - n * ln(2)))), 7) AS p FROM e GROUP BY owner, positive, negative"""
_by_counts("sign_test", _SIGNS, "owner", lambda a, b: (a, b, round(kernels.sign_test(a, b), 7)), {"positive": "long", "negative": "long", "p": "double"}, oracle(_SIGN))

# --- graphs ---------------------------------------------------------------------------------------------------------

_DIRECTED = "SELECT DISTINCT owner AS a, 100000000 + mint AS b FROM trades WHERE side = 1 UNION SELECT DISTINCT 100000000 + mint AS a, owner AS b FROM trades WHERE side = -1"


@query("hop_levels", oracle(f"WITH RECURSIVE e AS ({_DIRECTED}), r(node, hop) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT e.b, hop + 1 FROM r JOIN e ON e.a = r.node WHERE hop < 4), n AS (SELECT a AS node FROM e UNION SELECT b FROM e UNION SELECT 3) SELECT n.node, coalesce(min(hop), -1) AS hop FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node"))
def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops along all flows from wallet 3, up to 4."""
    return hop_levels(run(spark, sf_dir, _DIRECTED), spark.range(3, 4).select(F.col("id").alias("node")), 4)


# --- wallets and calls with what was measured of them ---------------------------------------------------------------

_STATS = f""" SELECT owner, count(*) AS sales, count(*) FILTER (WHERE realized_cents > 0) AS wins, count(*) FILTER (WHERE basis_quality = 'tainted') AS tainted, {q('sum(realized_cents)', 1)} AS realized_cents FROM f GROUP BY owner"""
statement(
    "wallet_core_stats",
    f"WITH f AS ({_FIFO}), w AS ({_STATS}), a AS (SELECT owner, count(*) AS legs, count(DISTINCT mint) AS mints, CAST(sum(-side * cents) AS BIGINT) AS cash, max(d) - min(d) AS active_days FROM trades GROUP BY owner) SELECT a.owner, legs, mints, cash, active_days, coalesce(sales, 0) AS sales, coalesce(wins, 0) AS wins, coalesce(tainted, 0) AS tainted, realized_cents FROM a LEFT JOIN w ON w.owner = a.owner",
    f"WITH f AS ({_FIFO_PAIRS}), w AS ({_STATS}), a AS (SELECT owner, count(*) AS legs, count(DISTINCT mint) AS mints, CAST(sum(-side * cents) AS BIGINT) AS cash, max(d) - min(d) AS active_days FROM trades GROUP BY owner) SELECT a.owner, legs, mints, cash, active_days, coalesce(sales, 0) AS sales, coalesce(wins, 0) AS wins, coalesce(tainted, 0) AS tainted, realized_cents FROM a LEFT JOIN w ON w.owner = a.owner",
)

# The first barrier that a call's closes touch within 120 days decides: target, stop, or neither.
_BARRIERS = f", p AS (SELECT call_id, d, close, first_value(close) OVER (PARTITION BY call_id ORDER BY d {_SO_FAR}) AS entry FROM j), t AS (SELECT call_id, min(CASE WHEN close >= 1.5 * entry THEN d END) AS take_d, min(CASE WHEN close <= 0.7 * entry THEN d END) AS stop_d, max(d) AS last_d, {cut('max_by(close, d) / min_by(close, d) - 1', 6)} AS held FROM p GROUP BY call_id)"
_PATHS = "SELECT call_id, take_d, stop_d, last_d, CASE WHEN take_d < coalesce(stop_d, 1000000) THEN 'take' WHEN stop_d IS NOT NULL THEN 'stop' ELSE 'time' END AS first_ FROM t"
statement("bandit_exit_paths", f"WITH {_POSITIONS}{_BARRIERS} {_PATHS}", f"WITH {_POSITIONS_PAIRS}{_BARRIERS} {_PATHS}")
# An entry scores what its first barrier pays; one whose window the tape does not reach to the end of, and which touched none, is censored.
_ENTRY = ", z AS (SELECT max(d) AS now_ FROM trades), e AS (SELECT t.*, c.d AS called FROM t JOIN c ON c.call_id = t.call_id) SELECT call_id, CASE WHEN take_d < coalesce(stop_d, 1000000) THEN CAST(0.5 AS DOUBLE) WHEN stop_d IS NOT NULL THEN CAST(-0.3 AS DOUBLE) WHEN called + 120 <= now_ THEN held END AS score, take_d IS NULL AND stop_d IS NULL AND called + 120 > now_ AS censored FROM e, z"
statement("entry_score", f"WITH {_POSITIONS}{_BARRIERS}{_ENTRY}", f"WITH {_POSITIONS_PAIRS}{_BARRIERS}{_ENTRY}")
# What a caller claimed (a price on the call) against what its closes reached.
_RECORD = f"{_BARRIERS}, m AS (SELECT call_id, max(close) / max(entry) AS multiple FROM p GROUP BY call_id) SELECT calls.caller, count(*) AS n, count(multiple) AS measured, count(*) FILTER (WHERE multiple >= 2) AS doubled, {q('median(multiple)')} AS median_multiple, {cut('median(price)', 2)} AS median_claim, count(*) FILTER (WHERE multiple < 1.1) AS flat FROM calls LEFT JOIN m ON m.call_id = calls.call_id GROUP BY calls.caller"
statement("caller_record", f"WITH {_POSITIONS}{_RECORD}", f"WITH {_POSITIONS_PAIRS}{_RECORD}")

# --- survival -------------------------------------------------------------------------------------------------------


def _aalen_johansen(rows: str, cause: str) -> str:
    """All-cause survival and the incidence of one cause by time, from a table r (stratum, time_to, mode; mode is null if censored)."""
    return f"""{rows}, aj_n AS (SELECT stratum, time_to, count(*) AS n, count(mode) AS d, count(*) FILTER (WHERE mode = '{cause}') AS d1 FROM r GROUP BY stratum, time_to),
 aj_k AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY time_to DESC {_SO_FAR}) AS at_risk FROM aj_n),
 aj_s AS (SELECT *, exp(sum(ln(CASE WHEN d < at_risk THEN 1 - CAST(d AS DOUBLE) / at_risk ELSE 1e-300 END)) OVER (PARTITION BY stratum ORDER BY time_to {_SO_FAR})) AS surv FROM aj_k),
 aj_i AS (SELECT *, CAST(d1 AS DOUBLE) / at_risk * coalesce(lag(surv) OVER (PARTITION BY stratum ORDER BY time_to), 1) AS step FROM aj_s)
SELECT stratum, time_to, {q('surv', 7)} AS surv, {q(f'sum(step) OVER (PARTITION BY stratum ORDER BY time_to {_SO_FAR})', 7)} AS cif FROM aj_i"""


# Time from a call to its rule's exit, by the exit's cause, of callers with an even and an odd number.
_VERDICTS = ", v AS (SELECT call_id, CASE WHEN exit_ <> 'hold' THEN exit_ END AS mode, y.at AS at_d FROM (SELECT call_id, coalesce" + _RULES.split("\nSELECT call_id, coalesce")[1] + ") y), l AS (SELECT call_id, max(d) AS d FROM j GROUP BY call_id), r AS (SELECT calls.caller % 2 AS stratum, coalesce(v.at_d, l.d) - c.d + 1 AS time_to, v.mode FROM v JOIN l ON l.call_id = v.call_id JOIN c ON c.call_id = v.call_id JOIN calls ON calls.call_id = v.call_id)"
_EXITS = _RULES.split("\nSELECT call_id, coalesce")[0]
statement("verdict_survival_km", _aalen_johansen(f"WITH {_POSITIONS}{_EXITS}{_VERDICTS}", "rug"), _aalen_johansen(f"WITH {_POSITIONS_PAIRS}{_EXITS}{_VERDICTS}", "rug"))
# Time from a wallet's first unit of a coin to the first flat book; still held is censored.
_KEY = "PARTITION BY owner, mint ORDER BY d, slot, txi, cents"
_DESK = f"WITH w AS (SELECT owner, mint, d, delta, sum(delta) OVER ({_KEY} {_SO_FAR}) AS held FROM trades), b AS (SELECT owner, mint, min(d) AS opened, max(d) AS last FROM w WHERE held > 0 GROUP BY owner, mint), z AS (SELECT b.owner, b.mint, min(w.d) AS flat FROM b JOIN w ON w.owner = b.owner AND w.mint = b.mint AND w.d >= b.opened AND w.held <= 0 GROUP BY b.owner, b.mint), r AS (SELECT 0 AS stratum, coalesce(flat, last) - opened + 1 AS time_to, CASE WHEN flat IS NOT NULL THEN 'flat' END AS mode FROM b LEFT JOIN z ON z.owner = b.owner AND z.mint = b.mint)"
statement("desk_survival", _aalen_johansen(_DESK, "flat"))
# Time from a mint's first trade to its first fall by half and to its first doubling, whichever is sooner.
_KERNEL = f"WITH p AS (SELECT mint, d, px, first_value(px) OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents {_SO_FAR}) AS entry FROM trades), m AS (SELECT mint, min(d) AS d0, max(d) AS d1, min(CASE WHEN px <= 0.5 * entry THEN d END) AS half, min(CASE WHEN px >= 2 * entry THEN d END) AS twice FROM p GROUP BY mint), r AS (SELECT 0 AS stratum, least(coalesce(half, d1), coalesce(twice, d1)) - d0 + 1 AS time_to, CASE WHEN half < coalesce(twice, 1000000) THEN 'halved' WHEN twice IS NOT NULL THEN 'doubled' END AS mode FROM m)"
statement("kernel_aalen_johansen", _aalen_johansen(_KERNEL, "halved"))

# --- scores from history --------------------------------------------------------------------------------------------

# A launch's deployer is its first buyer; its record is its earlier launches and how many of them fell to a third of their first price.
statement(
    "launch_score",
    f"""WITH b AS (SELECT mint, min_by(owner, struct(d, slot, txi, owner)) AS deployer, min(d) AS born, min(px) / min_by(px, struct(d, slot, txi, owner, cents)) AS low FROM trades WHERE side = 1 GROUP BY mint),
 h AS (SELECT mint, deployer, born, count(*) OVER w AS launches, coalesce(sum(CASE WHEN low < 0.34 THEN 1 ELSE 0 END) OVER w, 0) AS rugs FROM b WINDOW w AS (PARTITION BY deployer ORDER BY born RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT mint, deployer, launches, CAST(rugs AS BIGINT) AS rugs, CASE WHEN launches = 0 THEN 'unscored' WHEN rugs * 2 >= launches THEN 'danger' WHEN rugs > 0 THEN 'watch' ELSE 'clean' END AS verdict FROM h""",
)
# A trade's size among the mint's earlier trades, by rank.
statement(
    "crime_features",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents) AS rn FROM trades) SELECT x.mint, x.slot, x.txi, x.owner, x.cents, count(y.mint) AS n, CAST(coalesce(sum(y.delta), 0) AS BIGINT) AS flow, CASE WHEN count(y.mint) > 0 THEN CAST(count(*) FILTER (WHERE y.qty <= x.qty) AS DOUBLE) / count(y.mint) END AS size_rank FROM o x LEFT JOIN (SELECT mint, qty, delta, explode(sequence(rn + 1, rn + 10)) AS at FROM o) y ON y.mint = x.mint AND y.at = x.rn GROUP BY x.mint, x.slot, x.txi, x.owner, x.cents",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY d, slot, txi, owner, cents) AS rn FROM trades) SELECT x.mint, x.slot, x.txi, x.owner, x.cents, count(y.mint) AS n, CAST(coalesce(sum(y.delta), 0) AS BIGINT) AS flow, CASE WHEN count(y.mint) > 0 THEN CAST(count(*) FILTER (WHERE y.qty <= x.qty) AS DOUBLE) / count(y.mint) END AS size_rank FROM o x LEFT JOIN o y ON y.mint = x.mint AND y.rn BETWEEN x.rn - 10 AND x.rn - 1 GROUP BY x.mint, x.slot, x.txi, x.owner, x.cents",
)
# The last known call of each mint by strata of mints' volume, cut at the exact quartiles.
statement("market_atlas", "WITH v AS (SELECT mint, CAST(sum(qty) AS DOUBLE) AS v FROM trades GROUP BY mint), c AS (SELECT percentile(v, 0.25) AS a, percentile(v, 0.5) AS b, percentile(v, 0.75) AS c FROM v), s AS (SELECT mint, CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 WHEN v <= c.c THEN 3 ELSE 4 END AS stratum FROM v, c), l AS (SELECT call_id, mint, price, row_number() OVER (PARTITION BY mint ORDER BY t DESC, call_id DESC) AS rn FROM calls WHERE t <= 86400 * 1300) SELECT l.call_id, l.mint, price, stratum FROM l LEFT JOIN s ON s.mint = l.mint WHERE rn = 1")
statement("source_watermarks", "WITH g AS (SELECT caller, t, t - lag(t) OVER (PARTITION BY caller ORDER BY t, call_id) AS gap FROM calls), z AS (SELECT max(t) AS now_ FROM calls) SELECT caller, max(t) AS delivered_through, max(now_) - max(t) AS behind, max(gap) AS longest_gap, count(*) AS n FROM g, z GROUP BY caller")
# Templates: the set of a whole text's words; a group needs two texts and two sources.
statement(
    "shared_template_groups",
    "WITH w AS (SELECT doc_id, source, md5(array_join(array_sort(array_distinct(filter(split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' '), ' '), x -> x <> ''))), ' ')) AS template FROM documents) SELECT template, count(*) AS docs, count(DISTINCT source) AS accounts FROM w GROUP BY template HAVING count(DISTINCT source) >= 2",
    "WITH w AS (SELECT doc_id, source, md5(array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))), ' ')) AS template FROM documents) SELECT template, count(*) AS docs, count(DISTINCT source) AS accounts FROM w GROUP BY template HAVING count(DISTINCT source) >= 2",
)
statement("crew_persistence_membership", "WITH e AS (SELECT owner, mint, min(d) AS d FROM trades GROUP BY owner, mint), a AS (SELECT DISTINCT owner FROM e WHERE d >= 1300), b AS (SELECT owner, count(*) AS coins FROM e WHERE d < 1300 GROUP BY owner HAVING count(*) >= 2) SELECT count(*) AS n, count(b.owner) AS seen, CAST(coalesce(sum(coins), 0) AS BIGINT) AS earlier_coins FROM a LEFT JOIN b ON b.owner = a.owner")
# Names that one part alone has resolve to it; the others are ambiguous.
statement("entity_mint_resolution", "SELECT p_name AS name, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS mint, count(*) AS n, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part GROUP BY p_name")


def diurnal_profile(h, draws: int = 19) -> str:
    """Mean share of the day by hour, and how often days turned by drawn hours give as large a spread."""
    turn = h("concat('hour', CAST(b AS STRING), '-', CAST(d AS STRING))")
    return f"""WITH c AS (SELECT d, (t div 3600) % 24 AS hour, CAST(sum(qty) AS DOUBLE) AS v FROM trades GROUP BY 1, 2), m AS (SELECT d, sum(v) AS m FROM c GROUP BY d), s AS (SELECT c.d, hour, v / m AS s FROM c JOIN m ON m.d = c.d),
 g AS (SELECT d, hour, s, explode(sequence(0, {draws})) AS b FROM s), r AS (SELECT b, CASE WHEN b = 0 THEN hour ELSE (hour + {turn} % 24) % 24 END AS hour, sum(s) AS s FROM g GROUP BY 1, 2),
 v AS (SELECT b, {q('stddev_pop(s) / avg(s)', 9)} AS spread FROM r GROUP BY b), o AS (SELECT spread FROM v WHERE b = 0), p AS (SELECT CAST(1 + count(*) FILTER (WHERE v.b > 0 AND v.spread >= o.spread) AS DOUBLE) / count(*) AS p FROM v, o)
SELECT r.hour, {q('r.s', 6)} AS profile, p.p FROM r, p WHERE r.b = 0"""


resampled("diurnal_profile", diurnal_profile)
