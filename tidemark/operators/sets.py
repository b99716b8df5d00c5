"""Set operators and interval algebra."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.intervals import interval_subtract, interval_union
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle

statement("union_all", "SELECT slot, owner, qty AS raw FROM trades WHERE side = 1 UNION ALL SELECT slot, owner, -qty AS raw FROM trades WHERE side = -1")
statement("union_distinct", "SELECT mint FROM trades WHERE qty > 48 UNION SELECT mint FROM calls WHERE price > 400000")
statement("set_intersection_rule", "SELECT mint FROM trades WHERE qty > 45 INTERSECT SELECT mint FROM calls WHERE price > 200000")
statement("multi_sweep_union_dedupe", "SELECT mint, owner, concat_ws(',', sort_array(collect_set(shape))) AS shapes FROM (SELECT mint, owner, 'buy' AS shape FROM trades WHERE side = 1 UNION ALL SELECT mint, owner, 'sell' AS shape FROM trades WHERE side = -1 UNION ALL SELECT mint, owner, 'big' AS shape FROM trades WHERE qty > 40) x GROUP BY mint, owner", "SELECT mint, owner, array_to_string(list_sort(list(DISTINCT shape)), ',') AS shapes FROM (SELECT mint, owner, 'buy' AS shape FROM trades WHERE side = 1 UNION ALL SELECT mint, owner, 'sell' AS shape FROM trades WHERE side = -1 UNION ALL SELECT mint, owner, 'big' AS shape FROM trades WHERE qty > 40) x GROUP BY mint, owner")
statement("interval_clip", "SELECT owner, greatest(d, 400) AS start, least(d + txi * 10, 2000) AS end_ FROM trades WHERE d < 2000 AND d + txi * 10 > 400")

_BASE = 'SELECT owner, d AS start, d + txi * 3 AS "end" FROM trades WHERE side = 1'
_HOLES = 'SELECT owner, d AS start, d + 5 AS "end" FROM trades WHERE side = -1'
_MERGED = """i AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM b),
 n AS (SELECT *, sum(opens) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM i), u AS (SELECT owner, min(start) AS start, max("end") AS "end" FROM n GROUP BY owner, k)"""


def _frames(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return run(spark, sf_dir, text.replace('"', "`"))


@query("interval_union", oracle(f'WITH b AS ({_BASE}), {_MERGED} SELECT owner, start, "end" FROM u'))
def union_of_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_union(_frames(spark, sf_dir, _BASE), "owner")


@query("covered_seconds", oracle(f'WITH b AS ({_BASE}), {_MERGED} SELECT owner, CAST(sum("end" - start) AS BIGINT) AS covered FROM u GROUP BY owner'))
def covered_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_union(_frames(spark, sf_dir, _BASE), "owner").groupBy("owner").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("interval_subtract", oracle(f"""WITH days AS (SELECT DISTINCT owner, unnest(generate_series(start, "end" - 1)) AS d FROM ({_BASE})), holes AS (SELECT DISTINCT owner, unnest(generate_series(start, "end" - 1)) AS d FROM ({_HOLES})),
 k AS (SELECT days.owner, days.d FROM days LEFT JOIN holes ON days.owner = holes.owner AND days.d = holes.d WHERE holes.d IS NULL), g AS (SELECT owner, d, d - row_number() OVER (PARTITION BY owner ORDER BY d) AS k FROM k)
SELECT owner, min(d) AS start, max(d) + 1 AS "end" FROM g GROUP BY owner, k"""))
def subtract_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_subtract(_frames(spark, sf_dir, _BASE), _frames(spark, sf_dir, _HOLES), "owner")


statement("listening_intervals", "WITH g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 86400 THEN 0 ELSE 1 END AS opens, event_id FROM ev), k AS (SELECT user_id, t, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM k GROUP BY user_id, k")
statement("gap_cluster", "WITH g AS (SELECT mint, d, CASE WHEN d - lag(d) OVER (PARTITION BY mint ORDER BY d) <= 30 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT mint, d FROM trades) y), k AS (SELECT mint, d, sum(opens) OVER (PARTITION BY mint ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT mint, min(d) AS first, max(d) AS last, count(*) AS n FROM k GROUP BY mint, k")
statement("pool_watch_gaps", "SELECT user_id, t, gap FROM (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev) x WHERE gap > 86400 * 3")
statement("bin_chunking", "WITH b AS (SELECT DISTINCT owner, d FROM trades), r AS (SELECT owner, d, row_number() OVER (PARTITION BY owner ORDER BY d) AS rn FROM b), i AS (SELECT owner, d, d - rn AS island FROM r), c AS (SELECT owner, d, island, (row_number() OVER (PARTITION BY owner, island ORDER BY d) - 1) div 2 AS chunk FROM i) SELECT owner, min(d) AS lo, max(d) AS hi, count(*) AS n FROM c GROUP BY owner, island, chunk")
statement("gap_broken_series", "WITH s AS (SELECT mint, d, max(px) AS px FROM trades GROUP BY mint, d), g AS (SELECT mint, d, px, lag(d) OVER (PARTITION BY mint ORDER BY d) AS before FROM s) SELECT mint, d, px FROM g UNION ALL SELECT mint, before + 1 AS d, CAST(NULL AS DOUBLE) AS px FROM g WHERE d - before > 60")
