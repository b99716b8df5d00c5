"""Stateful stream operators with timers: swarms of look-alike launches, and alerts on movers.

A processor's state is bounded: what a rule can no longer use is evicted as rows come, and
an event-time timer clears a key that falls silent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.machines import Movers
from tidemark.functions.text import one_edit
from tidemark.sources.code import ship
from tidemark.sources.scratch import path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: A watermark begins at 1970 and what is not after it is late, so day (or poll) 0 of a stream is put well behind that.
ORIGIN = 9_131


def instant(day: str) -> Column:
    """The event time of a day's (or poll's) number, as a stream's `at`."""
    return F.expr(f"timestamp_seconds(({day} + {ORIGIN}) * 86400)")


def _milliseconds(day: int) -> int:
    return (day + ORIGIN) * DAY_MS


def _day(milliseconds: int) -> int:
    return milliseconds // DAY_MS - ORIGIN


def replayed(rows: DataFrame, at: str, job: Callable[[DataFrame], DataFrame], name: str, ranges: int = 3) -> DataFrame:
    """What job makes of rows as a stream: they are appended to a folder in `ranges` ranges of `at`, oldest first, and after each the job runs to the end of what is there, from its checkpoint."""
    spark = rows.sparkSession
    ship(spark)
    source, out = path(spark, f"{name}-in"), path(spark, name)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        edges = rows.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
        cuts = [None, *sorted(set(edges)), None]
        schema = None
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.where((F.lit(True) if lo is None else F.col(at) > lo) & (F.lit(True) if hi is None else F.col(at) <= hi))
            part.write.mode("append").parquet(source)
            made = job(spark.readStream.schema(rows.schema).parquet(source))
            schema = made.schema
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema).parquet(out)
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Swarm(StatefulProcessor):
    """Links of a blocking key: each launch to the key's launch before it, or, under a name variant, to the last launch of every name one edit away; never over more than `window` days.

    Launches of one name hang together by the name's own key, so one of each name is
    enough: a variant's list holds as many rows as there are names that share it.
    """

    SCHEMA = "kind string, a long, b long, d long, run long"

    def __init__(self, window: int):
        self._window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._recent = handle.getListState("recent", "mint long, name string, d long, run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind = key[0]
        x = pd.concat(list(rows)).sort_values(["d", "mint"])
        recent = before = [tuple(r) for r in self._recent.get()]
        out = []
        for mint, name, d in zip(x["mint"].tolist(), x["name"].tolist(), x["d"].tolist(), strict=True):
            recent = [r for r in recent if r[2] >= d - self._window]
            if kind == "near":
                out += [(kind, r[0], mint, d, 0) for r in recent if one_edit(r[1], name)]
                recent = [r for r in recent if r[1] != name] + [(mint, name, d, 0)]
            else:
                run = recent[-1][3] + 1 if recent else 1
                out += [(kind, r[0], mint, d, run) for r in recent]
                recent = [(mint, name, d, run)]
        self._recent.put(recent)
        if not before:
            self._watch(recent)
        yield pd.DataFrame(out, columns=["kind", "a", "b", "d", "run"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = _day(expiredTimerInfo.getExpiryTimeInMs())
        recent = [tuple(r) for r in self._recent.get()]
        kept = [r for r in recent if r[2] >= now - self._window]
        self._recent.clear()
        if kept:
            self._recent.put(kept)
            self._watch(kept)
        return iter(())

    def _watch(self, recent: list[tuple]) -> None:
        """A key's one timer: when its last launch so far is out of reach, it clears the state or waits for a later one."""
        self._handle.registerTimer(_milliseconds(recent[-1][2] + self._window + 1))

    def close(self) -> None:
        pass


def swarm_links(keyed: DataFrame, window: int) -> DataFrame:
    """Links of a stream of (kind, key, mint, name, d, at), at being instant(d): kind, a, b, d (of the later launch), run (launches in a row under the key; the third is the key's onset)."""
    grouped = keyed.withWatermark("at", "1 day").groupBy("kind", "key")
    return grouped.transformWithStateInPandas(Swarm(window), Swarm.SCHEMA, "append", "eventTime")


class MoverAlerts(StatefulProcessor):
    """Alerts of a feed: what was last seen of its mints, and the polls of the last alerts.

    Each call leaves out what neither the age of an observation nor the cooldown needs any
    more; a timer does so for a feed that falls silent.
    """

    SCHEMA = "feed string, poll long, mint long, v5 long, reason string"

    def __init__(self, rules: Movers):
        self._rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getListState("seen", "mint long, v5 long, poll long, top boolean, alerted long")
        self._sent = handle.getListState("sent", "poll long")
        self._last = handle.getValueState("last", "poll long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))
        last = self._last.get()
        fresh, last = last is None, -1 if last is None else last[0]
        seen = {r[0]: tuple(r[1:]) for r in self._seen.get()}
        sent = [r[0] for r in self._sent.get()]
        out = []
        for poll, page in sorted(x.groupby("poll"), key=lambda p: p[0]):
            if poll <= last:
                continue  # a page that comes late proves nothing about what was seen after it
            last = int(poll)
            entries = sorted(zip(page["mint"].tolist(), page["v5"].tolist(), strict=True), key=lambda e: (-e[1], e[0]))
            alerts, now, sent = self._rules.poll(last, entries, seen, sent)
            seen |= now
            out += [(key[0], last, m, v5, why) for m, v5, why in alerts]
        self._keep(last, seen, sent)
        if fresh:
            self._handle.registerTimer(_milliseconds(last + self._rules.memory()))
        yield pd.DataFrame(out, columns=["feed", "poll", "mint", "v5", "reason"])

    def _keep(self, now: int, seen: dict[int, tuple], sent: list[int]) -> None:
        self._last.update((now,))
        for state, rows in ((self._seen, [(m, *s) for m, s in seen.items() if not self._rules.forgets(now, s[1], s[3])]), (self._sent, [(p,) for p in sent])):
            state.put(rows) if rows else state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (last,) = _day(expiredTimerInfo.getExpiryTimeInMs()), self._last.get()
        if last + self._rules.memory() > now:
            self._handle.registerTimer(_milliseconds(last + self._rules.memory()))
        else:
            self._seen.clear()
            self._sent.clear()
            self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


def mover_alerts(pages: DataFrame, rules: Movers) -> DataFrame:
    """Alerts of a stream of (feed, poll, mint, v5, at), at being instant(poll): each poll of a feed is a page."""
    return pages.withWatermark("at", "1 day").groupBy("feed").transformWithStateInPandas(MoverAlerts(rules), MoverAlerts.SCHEMA, "append", "eventTime")
