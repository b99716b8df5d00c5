"""The recorder of the tape: lines of a feed into events, watches, defects and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.operators.sql import run
from tidemark.plans.tape import oracle
from tidemark.sources.scratch import path
from tidemark.streaming.recorder import Recorder, record

_BODY = "event_id long, user_id long, kind string, t long, props string"
#: Every hundredth line is torn in the middle, as a crashed writer leaves it.
_TORN = 100


def decoded(lines: DataFrame) -> DataFrame:
    """value, with the fields of the line and k, the number inside its payload; a line that does not parse has no event_id."""
    body = F.from_json("value", _BODY)
    return lines.select("value", body.alias("b")).select("value", "b.*", F.get_json_object("b.props", "$.k").try_cast("long").alias("k"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Events that happened; watches that signups open; lines that cannot be read. Errors moved nothing: they are only counted."""
    good = rows.where("event_id IS NOT NULL")
    return {
        "tape": good.where("kind <> 'error'").select("event_id", "user_id", "kind", "t", "k"),
        "watches": good.where("kind = 'signup'").select("user_id", F.col("t").alias("opened"), "event_id"),
        "defects": rows.where("event_id IS NULL").select("value", F.length("value").alias("length")),
    }


def tape(at: str) -> Recorder:
    return Recorder(at, tables, {"failed": F.expr("count_if(kind = 'error')"), "defects": F.expr("count_if(event_id IS NULL)"), "without_payload": F.expr("count_if(event_id IS NOT NULL AND k IS NULL)")})


_ORACLE = f"""WITH e AS (SELECT event_id, user_id, kind, t, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM ev WHERE event_id % {_TORN} <> 7)
SELECT 'tape' AS sink, kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM e WHERE kind <> 'error' GROUP BY kind
UNION ALL SELECT 'watches', 'signup', count(*), count(DISTINCT user_id) FROM e WHERE kind = 'signup'
UNION ALL SELECT 'defects', 'torn', count(*), count(*) FROM ev WHERE event_id % {_TORN} = 7
UNION ALL SELECT 'ledger', 'seen', count(*), count(*) FILTER (WHERE kind = 'error' AND event_id % {_TORN} <> 7) FROM ev"""


@query("tape_recorder", oracle(_ORACLE))
def tape_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of JSON lines recorded in two runs, and what its tables then hold: events by kind with the sum of their payloads, watches and their users, defects, lines seen and errors among them."""
    feed, at = path(spark, "feed"), path(spark, "tape")
    lines = run(spark, sf_dir, "SELECT event_id, user_id, kind, t, props FROM ev")
    line = F.to_json(F.struct(*lines.columns))
    text = lines.select("t", F.when(F.col("event_id") % _TORN == 7, F.substring(line, 1, 14)).otherwise(line).alias("value"))
    recorder = tape(at)
    middle = lines.agg(F.percentile_approx("t", 0.5)).first()[0] or 0
    for part in (F.col("t") <= middle, F.col("t") > middle):
        text.where(part).select("value").write.mode("append").text(feed)
        record(decoded(spark.readStream.text(feed)), recorder, f"{at}-checkpoint")
    tape_rows, watches, ledger = recorder.table(spark, "tape"), recorder.table(spark, "watches"), recorder.ledger(spark)
    out = tape_rows.groupBy(F.lit("tape").alias("sink"), "kind").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    out = out.unionByName(watches.agg(F.lit("watches").alias("sink"), F.lit("signup").alias("kind"), F.count("*").alias("n"), F.count_distinct("user_id").alias("total")))
    out = out.unionByName(recorder.table(spark, "defects").agg(F.lit("defects").alias("sink"), F.lit("torn").alias("kind"), F.count("*").alias("n"), F.count("value").alias("total")))
    return out.unionByName(ledger.agg(F.lit("ledger").alias("sink"), F.lit("seen").alias("kind"), F.sum("seen").alias("n"), F.sum("failed").alias("total")))
