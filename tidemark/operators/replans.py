"""Plans of operators whose plain statement would rank a whole table in one task or join all pairs of a key.

The plain statements stay as the oracles: each query here must equal them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import assoc
from tidemark.functions.close import ClosePairs
from tidemark.functions.ranks import numbered, quantiles, ranks, running, tiles
from tidemark.operators.market import _SCENES
from tidemark.operators.registry import replanned
from tidemark.operators.sql import hashed, q, run
from tidemark.sources.code import ship
from tidemark.sources.scratch import written

_SCORES = "SELECT l.quality AS y, CAST(length(d.text) AS DOUBLE) AS score, l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id"
_P_VALUES = "SELECT mint, exp(-CAST(abs(sum(delta)) AS DOUBLE) / 40) AS p FROM trades GROUP BY mint"


def _q(c: Column, digits: int = 4) -> Column:
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


@replanned("midrank")
def midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run(spark, sf_dir, "SELECT doc_id, n_chars FROM documents")
    return docs.join(ranks(docs, "n_chars"), "n_chars").select("doc_id", F.col("mid").alias("midrank"))


@replanned("rank_ties")
def rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = written(run(spark, sf_dir, "SELECT mint, CAST(sum(qty) AS BIGINT) AS v FROM trades GROUP BY mint"), "sums")
    return sums.join(ranks(sums, "v"), "v").select("mint", F.col("first").cast("long").alias("r"))


def _rank_sum(rows: DataFrame, value: str, hit: Column) -> DataFrame:
    """n1 (hits), n0 and r (the sum of the hits' middle ranks), from counts by value."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    total = running(counts, [value], F.col("n"), "upto")
    return total.agg(F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n0"), F.sum(F.col("k") * (F.col("upto") - (F.col("n") - 1) / F.lit(2.0))).alias("r"))


@replanned("auc_rank")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rank_sum(run(spark, sf_dir, _SCORES), "score", F.col("y") == 1)
    pairs = (F.col("n1") * F.col("n0")).cast("double")
    return s.select(F.when(pairs != 0, (F.col("r") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)) / pairs).alias("auc"))


@replanned("mannwhitney_cliff")
def mannwhitney_cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rank_sum(run(spark, sf_dir, "SELECT side, qty FROM trades"), "qty", F.col("side") == 1)
    n1, n2 = F.col("n1").cast("double"), F.col("n0").cast("double")
    u = F.col("r") - n1 * (n1 + 1) / 2
    return s.select(u.alias("u"), F.when(n1 * n2 != 0, 2 * u / (n1 * n2) - 1).alias("cliff"))


@replanned("spearman")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(run(spark, sf_dir, "SELECT mint, CAST(sum(qty) AS BIGINT) AS a, max(px) AS b FROM trades GROUP BY mint"), "pairs")
    ra, rb = (ranks(m, c).select(c, F.col("mid").alias(f"r{c}")) for c in "ab")
    return m.join(ra, "a").join(rb, "b").agg(_q(F.corr("ra", "rb"), 8).alias("rho"))


def _p_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    r = written(numbered(run(spark, sf_dir, _P_VALUES), ["p", "mint"]), "p-values")
    return r, r.count()


def _harmonic(r: DataFrame) -> float:
    return r.agg(F.sum(1.0 / F.col("rn"))).first()[0] or 0.0


def _rejected(r: DataFrame, limit: Column) -> DataFrame:
    k = r.where(F.col("p") <= limit).agg(F.max("rn")).first()[0] or 0
    return r.select("mint", (F.col("rn") <= k).alias("rejected"))


@replanned("benjamini_hochberg")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = _p_values(spark, sf_dir)
    return _rejected(r, 0.1 * F.col("rn") / m)


@replanned("benjamini_yekutieli")
def benjamini_yekutieli(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = _p_values(spark, sf_dir)
    return _rejected(r, 0.1 * F.col("rn") / (m * _harmonic(r)))


@replanned("operator_iceberg_fdr")
def operator_iceberg_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = _p_values(spark, sf_dir)
    raw = r.withColumn("raw", F.col("p") * m * _harmonic(r) / F.col("rn"))
    least = running(raw, [F.desc("rn")], F.col("raw"), "least", "min")
    return least.select("mint", _q(F.least("least", F.lit(1.0)), 8).alias("q"))


@replanned("calibration_deciles")
def calibration_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = run(spark, sf_dir, "SELECT l.quality AS y, CAST(least(length(d.text), 9999) AS DOUBLE) / 10000 AS p, l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
    return tiles(p, ["p", "doc_id"], 10, "decile").groupBy("decile").agg(F.count("*").alias("n"), _q(F.avg("p"), 8).alias("predicted"), _q(F.avg("y"), 8).alias("observed"))


@replanned("dose_response_bins")
def dose_response_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run(spark, sf_dir, "SELECT discount, slot, txi, owner, cents, side FROM trades")
    bins = tiles(t, ["discount", "slot", "txi", "owner", "cents"], 10, "bin")
    return bins.groupBy("bin").agg(_q(F.avg("discount"), 6).alias("dose"), (F.count_if(F.col("side") == 1) / F.count("*")).alias("rate"))


@replanned("decile_contrast")
def decile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(run(spark, sf_dir, "SELECT mint, CAST(sum(qty) AS BIGINT) AS v, max(px) AS p FROM trades GROUP BY mint"), "sums")
    bins = tiles(m, ["v", "mint"], 10, "bin")
    return bins.agg(_q(F.median(F.when(F.col("bin") == 10, F.col("p"))) - F.median(F.when(F.col("bin") == 1, F.col("p")))).alias("contrast"))


@replanned("quantile_exact")
def quantile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(run(spark, sf_dir, "SELECT status, px FROM trades"), "status", "px", {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    return found.select("status", *(_q(F.col(c)).alias(c) for c in ("p25", "p50", "p95")))


@replanned("distribution_summary")
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "SELECT status, px FROM trades")
    found = quantiles(rows, "status", "px", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    counts = rows.groupBy("status").agg(F.count("px").alias("n"), (F.count("*") - F.count("px")).alias("absent"))
    return counts.join(found, "status", "left").select("status", "n", *(_q(F.col(c)).alias(c) for c in ("p25", "p50", "p75")), "absent")


def _statement(name: str, text: str) -> None:
    @replanned(name)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, text)


# Totals as a row joined to all instead of a window over all.
_statement("share_of_total", "WITH o AS (SELECT owner, count(*) AS n FROM trades GROUP BY owner), t AS (SELECT sum(n) AS n FROM o) SELECT owner, CAST(o.n AS DOUBLE) / t.n AS share FROM o, t")
_statement("standardize", "WITH s AS (SELECT mint, CAST(sum(qty) AS DOUBLE) AS v FROM trades GROUP BY mint), m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM s) SELECT mint, floor(((v - mu) / nullif(sd, 0)) * 1e6 + 0.5) / 1e6 AS z FROM s, m")
# The first rows by a sort that every task cuts, and only then their numbers.
_statement("rank_cards", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY k, o_totalprice DESC, o_orderkey) AS BIGINT) AS card FROM (SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS k FROM orders ORDER BY k, o_totalprice DESC, o_orderkey LIMIT 100) x")
# Pairs within a bounded time meet by time buckets of the bound.
_statement("co_trade_slot_window_join", "SELECT least(a.owner, b.owner) AS w1, greatest(a.owner, b.owner) AS w2, count(*) AS n FROM (SELECT owner, mint, d, d div 3 AS at FROM trades) a JOIN (SELECT owner, mint, d, explode(sequence(d div 3 - 1, d div 3 + 1)) AS at FROM trades) b ON a.mint = b.mint AND a.at = b.at AND abs(a.d - b.d) <= 3 AND a.owner < b.owner GROUP BY 1, 2")
_statement("prebuyers", "SELECT l.owner, count(DISTINCT c.call_id) AS n FROM (SELECT call_id, mint, t, explode(sequence(t div 864000 - 1, t div 864000)) AS at FROM calls) c JOIN (SELECT owner, mint, t, side, t div 864000 AS at FROM trades WHERE side = 1) l ON l.mint = c.mint AND l.at = c.at AND l.t < c.t AND l.t >= c.t - 864000 GROUP BY l.owner")
_statement("arrival_count_window", "SELECT c.call_id, count(l.mint) AS n FROM (SELECT call_id, mint, t, explode(sequence(t div 1728000, t div 1728000 + 1)) AS at FROM calls) c LEFT JOIN (SELECT mint, t, t div 1728000 AS at FROM trades) l ON l.mint = c.mint AND l.at = c.at AND l.t >= c.t AND l.t < c.t + 1728000 GROUP BY c.call_id")
_SIXTY = "(SELECT *, explode(sequence(t div 5184000, t div 5184000 + 1)) AS at FROM calls) c JOIN (SELECT *, t div 5184000 AS at FROM trades) l ON l.mint = c.mint AND l.at = c.at"
_statement("entry_window_measure", f"SELECT c.call_id, count(*) AS n, min_by(l.px, struct(l.t, l.slot, l.txi, l.owner, l.cents)) AS first, max(l.px) AS high, min(l.px) AS low FROM {_SIXTY} AND l.t >= c.t AND l.t < c.t + 86400 * 60 GROUP BY c.call_id")
_statement("burst_statistic", "WITH p AS (SELECT a.mint, a.slot, a.txi, a.owner, a.cents, count(DISTINCT b.owner) AS n FROM (SELECT *, d div 20 AS at FROM trades) a JOIN (SELECT mint, owner, d, explode(sequence(d div 20 - 1, d div 20 + 1)) AS at FROM trades) b ON a.mint = b.mint AND a.at = b.at AND abs(a.d - b.d) <= 20 AND a.owner <> b.owner GROUP BY a.mint, a.slot, a.txi, a.owner, a.cents) SELECT mint, floor((avg(CAST(n AS DOUBLE))) * 1e6 + 0.5) / 1e6 AS burst FROM p GROUP BY mint")
# What a call knows of its mint so far, or finds from then on, is a running window over trades and calls together.
_BOTH = "b AS (SELECT mint, t, CAST(NULL AS BIGINT) AS call_id, px, delta, owner, slot, txi, cents FROM trades UNION ALL SELECT mint, {t}, call_id, NULL, NULL, NULL, NULL, NULL, NULL FROM calls)"
_statement("selection_outcomes", f"WITH {_BOTH.format(t='t + 432000')}, n AS (SELECT call_id, first_value(px) IGNORE NULLS OVER (PARTITION BY mint ORDER BY t, CASE WHEN call_id IS NULL THEN 1 ELSE 0 END, slot, txi, owner, cents ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS px FROM b) SELECT call_id, px FROM n WHERE call_id IS NOT NULL AND px IS NOT NULL")
_statement("callout_peak_multiple", f"WITH {_BOTH.format(t='t')}, n AS (SELECT call_id, first_value(px) IGNORE NULLS OVER w AS first, max(px) OVER w AS high FROM b WINDOW w AS (PARTITION BY mint ORDER BY t, CASE WHEN call_id IS NULL THEN 1 ELSE 0 END, slot, txi, owner, cents ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT call_id, greatest(1.0D, high / first) AS multiple FROM n WHERE call_id IS NOT NULL AND first IS NOT NULL")
_statement(
    "onchain_features_at_call",
    f"""WITH {_BOTH.format(t='t')}, f AS (SELECT *, CASE WHEN call_id IS NULL AND row_number() OVER (PARTITION BY mint, owner ORDER BY t, slot, txi, cents) = 1 THEN 1 ELSE 0 END AS opens FROM b),
 n AS (SELECT call_id, count(px) OVER w AS n, CAST(sum(opens) OVER w AS BIGINT) AS owners, CAST(sum(delta) OVER w AS BIGINT) AS flow, max(px) OVER w AS top FROM f WINDOW w AS (PARTITION BY mint ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT call_id, n, owners, flow, top FROM n WHERE call_id IS NOT NULL AND n > 0""",
)
# What stands within a bounded time of a row is a window of that range: no pairs are made.
_statement(
    "both_edges_touch",
    "SELECT CAST(w AS DOUBLE) AS w, count(*) AS n, count(*) FILTER (WHERE hi >= px + w AND lo <= px - w) AS both_edges FROM (SELECT mint, px, max(px) OVER v AS hi, min(low) OVER v AS lo FROM (SELECT mint, d, max(px) AS px, min(px) AS low FROM trades GROUP BY mint, d) g WINDOW v AS (PARTITION BY mint ORDER BY d RANGE BETWEEN 1 FOLLOWING AND 120 FOLLOWING)) x, (VALUES (0.0), (0.05), (0.5)) AS ws(w) WHERE hi IS NOT NULL GROUP BY w",
)
_statement(
    "buy_call_sell_choreography",
    f"""WITH b AS (SELECT mint, t, CAST(NULL AS BIGINT) AS call_id, side FROM trades UNION ALL SELECT mint, t, call_id, NULL FROM calls),
 n AS (SELECT call_id, count(side) OVER (PARTITION BY mint ORDER BY t RANGE BETWEEN 3456000 PRECEDING AND 3456000 FOLLOWING) AS n,
  sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY t RANGE BETWEEN 3456000 PRECEDING AND 1 PRECEDING) AS bought, sum(CASE WHEN side = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 3456000 FOLLOWING) AS sold FROM b)
SELECT call_id, CASE WHEN bought > 0 AND sold > 0 THEN 'buy_call_sell' WHEN bought > 0 THEN 'buy_call' WHEN sold > 0 THEN 'call_sell' ELSE 'none' END AS shape FROM n WHERE call_id IS NOT NULL AND n > 0""",
)
_statement(
    "signature_volatility_wall",
    """WITH g AS (SELECT mint, t, max(px) AS px FROM trades GROUP BY mint, t),
 s AS (SELECT mint, px, count(px) OVER v AS n, sum(px) OVER v AS p, sum(px * px) OVER v AS pp FROM g WINDOW v AS (PARTITION BY mint ORDER BY t RANGE BETWEEN 7776000 FOLLOWING AND 9504000 FOLLOWING))
SELECT mint, floor((sum(pp - 2 * px * p + n * px * px) / sum(n) / (100 * avg(px) * avg(px))) * 1e8 + 0.5) / 1e8 AS sigma2 FROM s GROUP BY mint HAVING sum(n) > 0""",
)


@replanned("cosigning_links")
def cosigning_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of one slot in pairs; a slot with very many owners is met in parts."""
    links = assoc.co_occurrence(run(spark, sf_dir, "SELECT DISTINCT owner AS row, slot AS col FROM trades"))
    return links.select(F.col("row").alias("a"), F.col("col").alias("b"), F.col("val").cast("long").alias("n"))


def _cuts(df: DataFrame, value: str, at: list[float]) -> list[Column]:
    """Quantiles of a whole column as constants: its distinct values are counted and dealt by range, so no task holds the column."""
    row = quantiles(df.select(F.lit(0).alias("_g"), value), "_g", value, {f"_{i}": p for i, p in enumerate(at)}).first()
    return [F.lit(row[f"_{i}"] if row is not None else None).cast("double") for i in range(len(at))]


def _quarter(value: str, cuts: list[Column], base: int) -> Column:
    """Which part of the cuts a value is in, from `base` on."""
    out = F.when(F.col(value) <= cuts[0], base)
    for i, c in enumerate(cuts[1:], 1):
        out = out.when(F.col(value) <= c, base + i)
    return out.otherwise(base + len(cuts))


@replanned("quartile_cell_key")
def quartile_cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run(spark, sf_dir, "SELECT d, CAST(qty AS DOUBLE) AS qty, CAST(cents AS DOUBLE) AS cents FROM trades")
    past = t.where("d < 1200")
    cell = F.concat_ws("|", _quarter("qty", _cuts(past, "qty", [0.25, 0.5, 0.75]), 0).cast("string"), _quarter("cents", _cuts(past, "cents", [0.5]), 0).cast("string"))
    return t.where("d >= 1200").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@replanned("market_atlas")
def market_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(run(spark, sf_dir, "SELECT mint, CAST(sum(qty) AS DOUBLE) AS v FROM trades GROUP BY mint"), "volumes")
    strata = v.select("mint", _quarter("v", _cuts(v, "v", [0.25, 0.5, 0.75]), 1).alias("stratum"))
    latest = run(spark, sf_dir, "SELECT call_id, mint, price FROM (SELECT call_id, mint, price, row_number() OVER (PARTITION BY mint ORDER BY t DESC, call_id DESC) AS rn FROM calls WHERE t <= 86400 * 1300) x WHERE rn = 1")
    return latest.join(strata, "mint", "left").select("call_id", "mint", "price", "stratum")


@replanned("cell_model")
def cell_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(run(spark, sf_dir, "SELECT mint, CAST(sum(qty) AS DOUBLE) AS v, CAST(count(DISTINCT owner) AS DOUBLE) AS o, CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM trades WHERE d < 1200 GROUP BY mint"), "cells")
    row = m.agg(F.sum("k") / F.sum("n")).first()
    p = F.lit(row[0]).cast("double")
    keys = [_quarter(c, _cuts(m, c, [0.25, 0.5, 0.75]), 1).alias(name) for c, name in (("v", "volume_quartile"), ("o", "owner_quartile"))]
    return m.groupBy(*keys).agg(F.count("*").alias("mints"), ((F.sum("k") + 20 * p) / (F.sum("n") + 20)).alias("shrunk"))


@replanned("slot_chain_order")
def slot_chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members know only the reserves before and after them: their order comes back by following after = before, the distance followed doubling until no chain goes on. Members that move nothing stand at one reserve and keep their order there."""
    order = "txi, owner, cents"
    members = written(run(spark, sf_dir, f"SELECT slot, txi, owner, cents, qty, CAST(sum(qty) OVER (PARTITION BY slot ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after FROM trades"), "members")
    reserves = members.groupBy("slot", "after").agg(F.count("*").alias("n"), F.min(F.col("after") - F.col("qty")).alias("before"))
    # covered: members at the reserves followed so far; at: the reserve where the chain goes on.
    chain = written(reserves.select("slot", "after", "n", F.col("n").alias("covered"), F.when(F.col("before") < F.col("after"), F.col("before")).alias("at")), "chain")
    while not chain.where("at IS NOT NULL").isEmpty():
        on = chain.select(F.col("slot").alias("_slot"), F.col("after").alias("_after"), F.col("covered").alias("_covered"), F.col("at").alias("_at"))
        met = chain.join(on, F.col("slot").eqNullSafe(F.col("_slot")) & (F.col("at") == F.col("_after")), "left")
        chain = written(met.select("slot", "after", "n", (F.col("covered") + F.coalesce("_covered", F.lit(0))).alias("covered"), F.col("_at").alias("at")), "chain")
    first = chain.select(F.col("slot").alias("_slot"), F.col("after").alias("_after"), (F.col("covered") - F.col("n")).alias("_first"))
    here = members.withColumn("_here", F.expr(f"row_number() OVER (PARTITION BY slot, after ORDER BY {order})"))
    placed = here.join(first, F.col("slot").eqNullSafe(F.col("_slot")) & (F.col("after") == F.col("_after")))
    return placed.select("slot", "txi", (F.col("_first") + F.col("_here") - 1).cast("long").alias("place"))


#: Of burst_null: its window and bandwidth in days, and its draws of each kind.
BURST = (20, 60, 19)


def _burst_pairs(spark: SparkSession, sf_dir: str, bucketed: bool) -> DataFrame:
    """series (0 as observed, then envelopes, then uniform draws), pairs of trades of other owners within the window; bucketed: in the same bucket of the window's width or the next."""
    window, bandwidth, draws = BURST
    ship(spark)
    # A given number, as the rows are few only until they are drawn.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tape = run(spark, sf_dir, "SELECT mint, slot, txi, owner, d FROM trades WHERE mint IS NOT NULL").repartition(parts, "mint")
    tape.createOrReplaceTempView("burst_tape")
    at = "CAST(b AS STRING), '-', coalesce(CAST(slot AS STRING), ''), '-', coalesce(CAST(txi AS STRING), ''), '-', CAST(owner AS STRING)"
    draw = lambda salt: hashed(f"concat('{salt}', {at})", "spark")
    day = (lambda e: f"({e}) div {window}") if bucketed else (lambda e: e)
    # Drawn after the only shuffle: rows are dealt by mint and sorted before they are many.
    drawn = spark.sql(f"""SELECT mint, owner, b, {day(f"CASE WHEN b = 0 THEN d ELSE greatest(d + {draw('env')} % {2 * bandwidth + 1} - {bandwidth}, 0) END")} AS near,
 {day(f"CASE WHEN b > 0 THEN lo + {draw('uni')} % (hi - lo + 1) END")} AS far
FROM (SELECT *, explode(sequence(0, {draws})) AS b FROM (SELECT *, min(d) OVER w AS lo, max(d) OVER w AS hi FROM burst_tape WINDOW w AS (PARTITION BY mint)) x WHERE hi > lo AND owner IS NOT NULL SORT BY mint, owner) y""")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = ([ClosePairs(1 if bucketed else window, 2 * draws + 1) for _ in range(2)] for _ in range(2))
        for batch in batches:
            mint, owner, b = (batch.column(i).to_numpy() for i in range(3))
            for i, shift, (every, own) in ((3, 0, near), (4, draws, far)):
                seen = batch.column(i).is_valid().to_numpy(zero_copy_only=False)
                days = batch.column(i).fill_null(0).to_numpy()[seen].astype(np.int64)
                every.feed([mint[seen]], b[seen].astype(np.int64) + shift, days)
                own.feed([mint[seen], owner[seen]], b[seen].astype(np.int64) + shift, days)
        pairs = sum(every.end() - own.end() for every, own in (near, far))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(pairs)], ["series", "pairs"])

    return drawn.mapInArrow(count, "series long, pairs long").groupBy("series").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


@replanned("burst_null")
def burst_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of other owners are all close pairs of a mint less those of one owner, counted along sorted days; neither pairs nor draws are shuffled."""
    draws = BURST[2]
    found = written(_burst_pairs(spark, sf_dir, False), "burst-pairs")
    if found.count() < 2 * draws + 1:
        # A draw without pairs counts with 0 where trades of other owners met in their buckets.
        met = _burst_pairs(spark, sf_dir, True).join(found, "series", "left_anti").select("series", F.lit(0).cast("long").alias("pairs"))
        found = written(found.unionByName(met), "burst-pairs")
    found.createOrReplaceTempView("burst_pairs")
    return spark.sql(f"""WITH z AS (SELECT CASE WHEN series = 0 THEN 'observed' WHEN series <= {draws} THEN 'envelope' ELSE 'uniform' END AS kind, pairs FROM burst_pairs)
SELECT z.kind, CAST(max(o.pairs) AS BIGINT) AS observed, {q('avg(CAST(z.pairs AS DOUBLE))', 4)} AS mean, CAST(1 + count(*) FILTER (WHERE z.pairs >= o.pairs) AS DOUBLE) / (1 + count(*)) AS p FROM z, (SELECT pairs FROM z WHERE kind = 'observed') o WHERE z.kind <> 'observed' GROUP BY z.kind""")


@replanned("anti_join_via_null")
def anti_join_via_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days between a mint's neighbouring days of trade: only those days are sorted, and absent days leave the task that makes them. Nothing matches a null mint, so all its days are absent."""
    return run(spark, sf_dir, """SELECT mint, explode(sequence(CASE WHEN mint IS NULL THEN d ELSE d + 1 END, coalesce(nxt - 1, d))) AS d
FROM (SELECT mint, d, lead(d) OVER (PARTITION BY mint ORDER BY d) AS nxt FROM (SELECT DISTINCT mint, d FROM trades WHERE d IS NOT NULL) m) x
WHERE mint IS NULL OR nxt > d + 1""")


#: Draws of selection_score, and by how many deviations the place of its cut may miss the expected one.
SCORE_DRAWS, SCORE_BAND = 29, 4.0


def _drawn_sums(spark: SparkSession, members: str, band: float | None) -> DataFrame:
    """d, b, n_chosen, k, taken, num: the sum of num over the n_chosen members of a scene with the least draws, by (d, mint, n_chosen, k, num, b); taken is less than n_chosen where the cut lies outside the band.

    Draws are compared as hex digits, whose order is that of the numbers. Members surely
    below the cut are summed as they are drawn, those surely above it are left out, and
    only those near it are sorted.
    """
    edge = lambda sign: f"lpad(lower(hex(CAST(least(greatest(n_chosen / k {sign} ({band} * sqrt(n_chosen / k * (1 - n_chosen / k) / k) + 4 / k), 0), 1) * 4294967295 AS BIGINT))), 8, '0')"
    low, high = ("'00000000'", "'ffffffff'") if band is None else (edge("-"), edge("+"))
    return spark.sql(f"""WITH g AS (SELECT d, mint, n_chosen, k, num, b, {low} AS low, {high} AS high, concat('-', coalesce(CAST(d AS STRING), ''), '-', coalesce(CAST(mint AS STRING), '')) AS name FROM {members}),
 e AS (SELECT *, explode(b) AS draw FROM g),
 u AS (SELECT d, mint, n_chosen, k, num, draw, low, high, substr(md5(concat('scene', draw, name)), 1, 8) AS u FROM e),
 s AS (SELECT d, draw, n_chosen, k, CASE WHEN u >= low THEN u END AS u, CASE WHEN u >= low THEN mint END AS mint, count(*) AS n, sum(num) AS num FROM u WHERE u <= high GROUP BY 1, 2, 3, 4, 5, 6),
 r AS (SELECT *, sum(n) OVER (PARTITION BY d, draw ORDER BY u NULLS FIRST, mint ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT d, draw, n_chosen, k, coalesce(sum(CASE WHEN upto <= n_chosen THEN n END), 0) AS taken, sum(CASE WHEN upto <= n_chosen THEN num END) AS num FROM r GROUP BY d, draw, n_chosen, k""")


@replanned("selection_score")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws are summed scene by scene as they are made; ranks stay whole numbers, so sums do not depend on their order."""
    ranked = f"""WITH {_SCENES} SELECT d, mint, chosen, CAST(n_chosen AS BIGINT) AS n_chosen, k, 2 * (rank() OVER (PARTITION BY d ORDER BY outcome) - 1) + count(*) OVER (PARTITION BY d, outcome) - 1 AS num FROM e WHERE n_chosen > 0"""
    # A given number of files, as the members are few only until they are drawn.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = run(spark, sf_dir, ranked).where("n_chosen < k").repartition(parts, "d", "mint")
    written(members, "scene-members").createOrReplaceTempView("scene_members")
    every = ", ".join(f"'{b}'" for b in range(1, SCORE_DRAWS + 1))
    sums = written(_drawn_sums(spark, f"(SELECT *, array({every}) AS b FROM scene_members)", SCORE_BAND), "scene-draws")
    sums.where("taken < n_chosen").createOrReplaceTempView("scene_misses")
    again = spark.table("scene_misses")
    if not again.isEmpty():
        more = _drawn_sums(spark, "(SELECT m.*, x.b FROM scene_members m JOIN (SELECT d, collect_list(draw) AS b FROM scene_misses GROUP BY d) x ON x.d <=> m.d)", None)
        sums = sums.where("taken >= n_chosen").unionByName(more)
    sums.createOrReplaceTempView("scene_draws")
    return spark.sql(f"""WITH o AS (SELECT avg(r) AS score, count(*) AS scenes FROM (SELECT d, sum(num) / (2 * CAST(max(k) - 1 AS DOUBLE) * count(*)) AS r FROM scene_members WHERE chosen GROUP BY d) x),
 n AS (SELECT draw, avg(num / (2 * CAST(k - 1 AS DOUBLE) * n_chosen)) AS score FROM scene_draws GROUP BY draw)
SELECT {q('max(o.score)', 7)} AS score, max(o.scenes) AS scenes, CAST(1 + count(*) FILTER (WHERE abs(n.score - 0.5) >= abs(o.score - 0.5) - 1e-12) AS DOUBLE) / (1 + count(*)) AS p FROM n, o""")
