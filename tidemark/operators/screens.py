"""Candidate screens of how the tape responds, and how alike series are by compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import choice
from tidemark.functions.distance import candidate_pairs, compression_distances
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.sources.scratch import written

#: The day before which all that a fit sees must be known, and the days around a call that count.
CUTOFF, EXPOSURE = 1200, 30
MODELS = {"price": ["log_px"], "size": ["log_qty"], "terms": ["discount", "tax"], "all": ["log_px", "log_qty", "discount", "tax"]}
#: A choice set is a slot with two trades or more; chosen is the trade whose mint rose most by its next one.
_SETS = """SELECT slot, d, max(known) OVER (PARTITION BY slot) AS known, min(d) OVER (PARTITION BY slot) AS first_d, row_number() OVER (PARTITION BY slot ORDER BY rise DESC, txi, owner) = 1 AS chosen,
 log_px, log_qty, discount, tax, count(*) OVER (PARTITION BY slot) AS members
FROM (SELECT slot, d, txi, owner, discount * 10 AS discount, tax * 10 AS tax, ln(px) AS log_px, ln(qty + 1) AS log_qty, ln(lead(px) OVER w / px) AS rise, lead(d) OVER w AS known
 FROM trades WINDOW w AS (PARTITION BY mint ORDER BY d, slot, txi, owner)) x WHERE rise IS NOT NULL"""

#: Trades of a mint in the days before and after it was called, by the brand as context; rates as a log ratio with its interval.
EXCITATION = f"""SELECT context, n_calls, before, after, ln((after + 0.5D) / (before + 0.5D)) AS estimate,
 ln((after + 0.5D) / (before + 0.5D)) - 1.96D * sqrt(1 / (after + 0.5D) + 1 / (before + 0.5D)) AS lower, ln((after + 0.5D) / (before + 0.5D)) + 1.96D * sqrt(1 / (after + 0.5D) + 1 / (before + 0.5D)) AS upper
FROM (SELECT p_brand AS context, count(*) AS n_calls, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM (
 SELECT mint, called, sum(1 - called) OVER (PARTITION BY mint ORDER BY d RANGE BETWEEN {EXPOSURE} PRECEDING AND 1 PRECEDING) AS before,
  sum(1 - called) OVER (PARTITION BY mint ORDER BY d RANGE BETWEEN 1 FOLLOWING AND {EXPOSURE} FOLLOWING) AS after
 FROM (SELECT mint, d, 0 AS called FROM trades WHERE d < {CUTOFF} UNION ALL SELECT mint, (t - 43200) div 86400, 1 FROM calls WHERE (t - 43200) div 86400 + {EXPOSURE} < {CUTOFF}) s) e
 JOIN part ON p_partkey = mint WHERE called = 1 GROUP BY p_brand) x"""
_EXCITATION_PAIRS = f"""WITH c AS (SELECT mint, (t - 43200) div 86400 AS d FROM calls), k AS (
 SELECT p_brand AS context, count(*) AS n_calls, CAST(sum((SELECT count(*) FROM trades t WHERE t.mint = c.mint AND t.d < {CUTOFF} AND t.d BETWEEN c.d - {EXPOSURE} AND c.d - 1)) AS BIGINT) AS before,
  CAST(sum((SELECT count(*) FROM trades t WHERE t.mint = c.mint AND t.d BETWEEN c.d + 1 AND c.d + {EXPOSURE})) AS BIGINT) AS after
 FROM c JOIN part ON p_partkey = c.mint WHERE c.d + {EXPOSURE} < {CUTOFF} GROUP BY p_brand)
SELECT context, n_calls, before, after, ln((after + 0.5) / (before + 0.5)) AS estimate, ln((after + 0.5) / (before + 0.5)) - 1.96 * sqrt(1 / (after + 0.5) + 1 / (before + 0.5)) AS lower, ln((after + 0.5) / (before + 0.5)) + 1.96 * sqrt(1 / (after + 0.5) + 1 / (before + 0.5)) AS upper FROM k"""
statement("response_exposure_windows", EXCITATION, _EXCITATION_PAIRS)


@query("response_kernel_screen")
def response_kernel_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate models of what is chosen in a slot, fitted on sets whose outcomes were all known before day 1200 and ranked by the log likelihood of later sets: of a set, of one drawn blindly, and the weights."""
    rows = written(run(spark, sf_dir, _SETS).where("members > 1"), "choice-sets")
    train, later = rows.where(F.col("known") < CUTOFF), rows.where(F.col("first_d") >= CUTOFF)
    betas = choice.fit(train, "slot", "chosen", MODELS)
    n_train, _ = choice.evaluate(train, "slot", "chosen", MODELS, betas)
    n, held = choice.evaluate(later, "slot", "chosen", MODELS, betas)
    _, blind = choice.evaluate(later, "slot", "chosen", {"none": ["log_px"]}, {"none": betas["price"] * 0})
    order = sorted(MODELS, key=lambda m: (-held[m][0], m))
    out = [(order.index(m) + 1, m, ",".join(MODELS[m]), [round(float(b), 5) for b in betas[m]], n_train, n, round(held[m][0] / max(n, 1), 6), round(blind["none"][0] / max(n, 1), 6)) for m in MODELS]
    return spark.createDataFrame(out, "rank int, model string, terms string, weights array<double>, fitted_sets long, held_out_sets long, log_likelihood double, blind double")


_SYMBOLS = "SELECT owner AS item, d, slot, txi, concat(CASE WHEN delta > 0 THEN 'B' ELSE 'S' END, chr(65 + CAST(floor(log2(greatest(qty, 1))) AS INT)), chr(97 + least(25, CAST(floor(log2(1 + d - coalesce(lag(d) OVER w, d))) AS INT)))) AS symbol, mint FROM trades WINDOW w AS (PARTITION BY owner ORDER BY d, slot, txi)"


@query("ncd_matrix")
def ncd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised compression distances of owners' trades as strings of side, size and gap: of pairs that share rare stretches of symbols, and each one's compressed size."""
    items = written(run(spark, sf_dir, _SYMBOLS), "ncd-symbols")
    return compression_distances(items, candidate_pairs(items))
