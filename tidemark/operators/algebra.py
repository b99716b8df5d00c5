"""Associative arrays and graphs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import assoc
from tidemark.functions.graph import components
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.scratch import written

_T = "SELECT owner AS row, mint AS col, CAST(delta AS DOUBLE) AS val, d * 100000 + slot + txi / 10.0 AS ord FROM trades"
_A = f"SELECT row, col, sum(val) AS val FROM ({_T}) t GROUP BY row, col HAVING sum(val) <> 0"
_B = "SELECT mint AS row, txi AS col, CAST(sum(qty) AS DOUBLE) AS val FROM trades GROUP BY 1, 2 HAVING sum(qty) <> 0"


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.from_tuples(run(spark, sf_dir, _T).select("row", "col", "val"))


def _b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.from_tuples(run(spark, sf_dir, "SELECT mint AS row, txi AS col, CAST(qty AS DOUBLE) AS val FROM trades"))


def _mean_of_neighbours(a: DataFrame) -> DataFrame:
    """The mean Jaccard of rows of neighbouring numbers: only those pairs are ever made."""
    a, n = a.select("row", "col"), assoc.degree(a)
    both = a.join(a.select((F.col("row") - 1).alias("row"), "col"), ["row", "col"]).groupBy(F.col("row").alias("key")).agg(F.count("*").alias("both"))
    pairs = n.join(n.select((F.col("key") - 1).alias("key"), F.col("degree").alias("next")), "key").join(both, "key", "left").fillna(0, ["both"])
    return pairs.agg((F.floor(F.avg(F.col("both") / (F.col("degree") + F.col("next") - F.col("both"))) * 1e7 + 0.5) / 1e7).alias("mean"))


def _similar(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Pairs of rows with what they share. The degrees are written, so that their size is known and few are broadcast."""
    a = written(_a(spark, sf_dir).select("row", "col"), "entries")
    return assoc.similarity(assoc.co_occurrence(a, kept=True), written(assoc.degree(a), "degrees"), kind)


def _put(name: str, sql: str, f) -> None:
    query(name, oracle(sql))(f)


_put("assoc_from_tuples", f"SELECT row, col, sum(val) AS total, max(val) AS top, min(val) AS low FROM ({_T}) t GROUP BY row, col", lambda s, d: run(s, d, _T).groupBy("row", "col").agg(F.sum("val").alias("total"), F.max("val").alias("top"), F.min("val").alias("low")))
_put("assoc_transpose", f"SELECT col AS row, row AS col, val FROM ({_A}) a", lambda s, d: assoc.transpose(_a(s, d)))
_put("assoc_binarize", f"SELECT row, col, CAST(1 AS DOUBLE) AS val FROM ({_A}) a", lambda s, d: _a(s, d).withColumn("val", F.lit(1.0)))
_put("assoc_select", f"SELECT row, col, val FROM ({_A}) a WHERE regexp_matches(CAST(row AS VARCHAR), '^[0-9]*[05]$') AND col BETWEEN 20 AND 900 AND val > 10", lambda s, d: assoc.select(_a(s, d), row=re.compile("[0-9]*[05]"), col=range(20, 901), keep=F.col("val") > 10))
_put("assoc_restrict_degree", f"SELECT row, col, val FROM ({_A}) a WHERE col IN (SELECT col FROM ({_A}) z GROUP BY col HAVING count(*) <= 28)", lambda s, d: assoc.restrict_degree(_a(s, d), "col", 28))
_put("assoc_drop_diagonal", f"SELECT row, col, val FROM ({_A}) a WHERE row <> col", lambda s, d: _a(s, d).where("row != col"))
_put("assoc_degree", f"SELECT row AS key, count(*) AS degree FROM ({_A}) a GROUP BY row", lambda s, d: assoc.degree(_a(s, d)))
_put("assoc_rowsum_colsum", f"SELECT 'row' AS axis, row AS key, sum(val) AS total FROM ({_A}) a GROUP BY row UNION ALL SELECT 'col', col, sum(val) FROM ({_A}) a GROUP BY col", lambda s, d: _a(s, d).groupBy(F.lit("row").alias("axis"), F.col("row").alias("key")).agg(F.sum("val").alias("total")).unionByName(_a(s, d).groupBy(F.lit("col").alias("axis"), F.col("col").alias("key")).agg(F.sum("val").alias("total"))))
_AB = f"({_A}) a JOIN ({_B}) b ON a.col = b.row GROUP BY a.row, b.col"
_put("matmul_plus_times", f"SELECT a.row, b.col, sum(a.val * b.val) AS val FROM {_AB} HAVING sum(a.val * b.val) <> 0", lambda s, d: assoc.matmul(_a(s, d), _b(s, d)))
_put("matmul_or_and", f"SELECT a.row, b.col, CAST(1 AS DOUBLE) AS val FROM {_AB}", lambda s, d: assoc.matmul(_a(s, d), _b(s, d), "or_and"))
_put("matmul_max_plus", f"SELECT a.row, b.col, max(a.val + b.val) AS val FROM {_AB} HAVING max(a.val + b.val) <> 0", lambda s, d: assoc.matmul(_a(s, d), _b(s, d), "max_plus"))
_put("matmul_min_plus", f"SELECT a.row, b.col, min(a.val + b.val) AS val FROM {_AB} HAVING min(a.val + b.val) <> 0", lambda s, d: assoc.matmul(_a(s, d), _b(s, d), "min_plus"))
_put("matmul_max_min", f"SELECT a.row, b.col, max(least(a.val, b.val)) AS val FROM {_AB} HAVING max(least(a.val, b.val)) <> 0", lambda s, d: assoc.matmul(_a(s, d), _b(s, d), "max_min"))
_CO = f"SELECT x.row, y.row AS col, CAST(count(*) AS DOUBLE) AS val FROM ({_A}) x JOIN ({_A}) y ON x.col = y.col AND x.row < y.row GROUP BY x.row, y.row"
_put("co_occurrence", f"{_CO} HAVING count(*) >= 2", lambda s, d: assoc.co_occurrence(_a(s, d), 2))
_DEG = f"(SELECT row AS key, count(*) AS degree FROM ({_A}) a GROUP BY row)"
for _name, _kind, _by in (("jaccard", "jaccard", "p.degree + q.degree - o.val"), ("overlap_coefficient", "overlap", "least(p.degree, q.degree)"), ("cosine_norm", "cosine", "sqrt(CAST(p.degree AS DOUBLE) * q.degree)")):
    _put(_name, f"SELECT o.row, o.col, o.val / ({_by}) AS val FROM ({_CO}) o JOIN {_DEG} p ON p.key = o.row JOIN {_DEG} q ON q.key = o.col", lambda s, d, k=_kind: _similar(s, d, k))
_put("upper_pairs", f"SELECT row, col, val FROM ({_A}) a WHERE row < col", lambda s, d: _a(s, d).where("row < col"))
_put("threshold_prune", f"SELECT row, col, val FROM ({_A}) a WHERE val >= 30", lambda s, d: _a(s, d).where("val >= 30"))
_put("mean_jaccard_pairs", f"SELECT floor(sum(v) / max(n) * 1e7 + 0.5) / 1e7 AS mean FROM (SELECT coalesce(o.val / (p.degree + q.degree - o.val), 0) AS v, count(*) OVER () AS n FROM {_DEG} p JOIN {_DEG} q ON q.key = p.key + 1 LEFT JOIN ({_CO}) o ON o.row = p.key AND o.col = q.key) z",
     lambda s, d: _mean_of_neighbours(_a(s, d)))

_EDGES = "SELECT DISTINCT owner AS a, 100000 + mint AS b FROM trades"


@query("union_find_components", oracle(f"WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node"))
def union_find_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(run(spark, sf_dir, _EDGES))


@query("largest_component", oracle(f"WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node) SELECT component, count(*) AS size FROM c GROUP BY component ORDER BY size DESC, component LIMIT 1"))
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(run(spark, sf_dir, _EDGES)).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


_FUND = "SELECT c_nationkey AS funder, o_custkey AS funded, o_totalprice AS amount, t, call_id FROM calls JOIN orders ON o_orderkey = call_id JOIN customer ON c_custkey = o_custkey"
_FIRST = f"SELECT funded, min_by(funder, struct(t, call_id)) AS funder FROM ({_FUND}) f GROUP BY funded"
statement("first_funders", _FIRST)
statement("funder_fanout", f"SELECT funder, count(DISTINCT funded) AS fanout FROM ({_FIRST}) x GROUP BY funder")
statement("hub_exclusion", f"SELECT funded, funder FROM ({_FIRST}) x WHERE funder NOT IN (SELECT funder FROM ({_FIRST}) y GROUP BY funder HAVING count(*) > (SELECT count(*) / count(DISTINCT funder) FROM ({_FIRST}) z))")
statement("funding_links", f"SELECT funded AS a, hub AS b FROM (SELECT funded, min(funded) OVER (PARTITION BY funder) AS hub FROM ({_FIRST}) x) y WHERE funded <> hub")
statement("cosigning_links", "SELECT least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b, count(DISTINCT a.slot) AS n FROM trades a JOIN trades b ON a.slot = b.slot AND a.owner < b.owner GROUP BY 1, 2")
statement("bundle_links", "SELECT DISTINCT owner AS a, hub AS b FROM (SELECT owner, min(owner) OVER (PARTITION BY slot) AS hub, count(*) OVER (PARTITION BY slot) AS n FROM trades) x WHERE owner <> hub AND n <= 5")
statement("pairwise_scores", "WITH x AS (SELECT c_nationkey AS truth, c_custkey % 30 AS assigned, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 AS both_ FROM x), p AS (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 AS pred FROM (SELECT CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY assigned) y), r AS (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 AS actual FROM (SELECT CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY truth) z) SELECT both_ / nullif(pred, 0) AS precision_, both_ / nullif(actual, 0) AS recall FROM t, p, r")
statement("flow_edges", "SELECT owner AS source, 100000 + mint AS target, 'swap_in' AS kind, qty AS atoms, slot FROM trades WHERE side = 1 UNION ALL SELECT 100000 + mint AS source, owner AS target, 'swap_out' AS kind, qty AS atoms, slot FROM trades WHERE side = -1")
statement("incidence", "SELECT slot, txi, cents, owner AS node, -1 AS sign_ FROM trades UNION ALL SELECT slot, txi, cents, 100000 + mint AS node, 1 AS sign_ FROM trades")
statement("route_cycles", "SELECT slot, count(*) AS legs, coalesce(bool_and(nxt = txi + 1 OR nxt IS NULL), true) AS contiguous, min_by(mint, struct(txi, mint)) = max_by(mint, struct(txi, mint)) AS closed FROM (SELECT slot, txi, mint, lead(txi) OVER (PARTITION BY slot ORDER BY txi, mint) AS nxt FROM trades) x GROUP BY slot")
