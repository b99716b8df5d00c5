"""Stream operators with state and timers: against plain replays, and with a handle that shows what they keep."""

import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.machines import Movers
from tidemark.functions.text import one_edit
from tidemark.operators import registry
from tidemark.streaming.stateful import DAY_MS, ORIGIN, MoverAlerts, Swarm, instant, mover_alerts, replayed, swarm_links

DATA = "/root/testdata/sf0.001"


class State:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Value(State):
    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.rows = [row]


class Handle:
    """A key's states and timers in memory."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.append(at)


class Expired:
    def __init__(self, at):
        self._at = at

    def getExpiryTimeInMs(self):
        return self._at


def fire(processor, handle, until):
    while handle.timers and min(handle.timers) <= (until + ORIGIN) * DAY_MS:
        at = min(handle.timers)
        handle.timers.remove(at)
        list(processor.handleExpiredTimer(("k",), None, Expired(at)))


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return {frozenset(g) for g in out.values()}


def test_one_edit():
    assert one_edit("cat", "cut") and one_edit("cat", "cart") and one_edit("cat", "at") and one_edit("", "a") and one_edit("ab", "abb")
    assert not one_edit("cat", "cat") and not one_edit("cat", "tac") and not one_edit("cat", "carts") and not one_edit("ab", "ba")


def test_swarms_of_a_stream_are_those_of_all_pairs(spark):
    r = random.Random(4)
    names = ["pepe", "pepo", "epe", "doge", "dog", "moon", "moan", "man"]
    launches = [(i, r.choice(names), r.choice("AB"), r.randint(0, 120)) for i in range(150)]
    keyed = spark.createDataFrame(launches, "mint long, name string, sym string, d long").withColumn("at", instant("d"))
    variants = F.expr("array_distinct(concat(array(name), transform(sequence(1, length(name)), i -> concat(substr(name, 1, i - 1), substr(name, i + 1)))))")
    keyed = keyed.withColumn("x", F.explode(F.concat(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("symbol").alias("kind"), F.concat(F.col("sym"), F.lit("x")).alias("key"))), F.transform(variants, lambda v: F.struct(F.lit("near").alias("kind"), v.alias("key")))))).select("x.kind", "x.key", "mint", "name", "d", "at")
    for only in (["name", "near"], ["name", "near", "symbol"]):
        rows = replayed(keyed.where(F.col("kind").isin(only)), "d", lambda x: swarm_links(x, 3), "swarm-test", 4).collect()
        pairs = [(a[0], b[0]) for a in launches for b in launches if (a[3], a[0]) < (b[3], b[0]) and b[3] - a[3] <= 3 and (a[1] == b[1] or one_edit(a[1], b[1]) or ("symbol" in only and a[2] == b[2]))]
        assert groups([(x.a, x.b) for x in rows], [x[0] for x in launches]) == groups(pairs, [x[0] for x in launches])
        assert all((x.a, x.b) in pairs for x in rows)
        # A key's onset, its third launch in a row, comes once in each run.
        runs = defaultdict(list)
        for x in sorted(rows, key=lambda x: (x.d, x.b)):
            if x.kind == "symbol":
                runs[x.b].append(x.run)
        assert all(len(v) == 1 for v in runs.values())


def test_a_swarm_key_keeps_a_bounded_list_and_forgets_it():
    handle, p = Handle(), Swarm(5)
    p.init(handle)
    most = 0
    for day in range(0, 400):
        list(p.handleInputRows(("near", "pe"), iter([pd.DataFrame({"mint": [day * 3, day * 3 + 1, day * 3 + 2], "name": ["pep", "pxe", "pep"], "d": [day] * 3})]), None))
        most = max(most, len(handle.states["recent"].rows))
        fire(p, handle, day)
        assert len(handle.timers) == 1
    assert most == 2
    fire(p, handle, 404)
    assert len(handle.states["recent"].rows) == 2  # the last launches are still within reach
    fire(p, handle, 500)
    assert handle.states["recent"].rows == [] and handle.timers == []


def plain(pages, least, ratio, top_least, fresh, cooldown, room, span):
    """The rules page by page, over dictionaries that forget nothing."""
    seen, alerted, sent, newest, out = {}, {}, [], -1, []
    for poll, page in pages:
        if poll <= newest:
            continue
        newest = poll
        order = sorted(page, key=lambda m: (-page[m], m))
        found = []
        for m in order:
            v = page[m]
            old = seen.get(m)
            if old and poll - old[1] <= fresh:
                quick = old[0] > 0 and v >= least and v >= ratio * old[0]
                enters = m in order[:5] and not old[2] and v >= top_least
                if (quick or enters) and not (m in alerted and alerted[m] >= poll - cooldown):
                    found.append((poll, m, v, "accel" if quick else "top5_entry"))
        for m in page:
            seen[m] = (page[m], poll, m in order[:5])
        for x in found[: max(room - len([s for s in sent if s > poll - span]), 0)]:
            alerted[x[1]] = x[0]
            sent.append(x[0])
            out.append(x)
    return out


RULES = dict(least=40, ratio=3, top_least=30, fresh=5, cooldown=3, room=2, span=5)


def test_mover_alerts_equal_a_plain_replay_with_odd_orders_and_late_pages():
    r = random.Random(8)
    for _ in range(30):
        polls = sorted(r.sample(range(60), 30))
        for _ in range(6):  # some pages come late
            polls.insert(r.randint(5, len(polls)), r.choice(polls[:5]))
        pages = [(p, {m: r.choice([0, 5, 20, 45, 100, 300]) for m in r.sample(range(12), r.randint(1, 10))}) for p in polls]
        handle, processor, got = Handle(), MoverAlerts(Movers(**RULES)), []
        processor.init(handle)
        for p, page in pages:
            x = pd.DataFrame({"poll": p, "mint": list(page), "v5": list(page.values())}).sample(frac=1, random_state=1)
            for frame in processor.handleInputRows(("f",), iter([x]), None):
                got += [(a.poll, a.mint, a.v5, a.reason) for a in frame.itertuples()]
            now = handle.states["last"].get()[0]
            assert all(s[2] >= now - 5 or (s[4] is not None and s[4] >= now - 3) for s in handle.states["seen"].rows)
        assert got == plain(pages, **RULES)
        fire(processor, handle, 1000)
        assert not any(s.rows for s in handle.states.values())


def test_movers_query_equals_a_plain_replay(spark):
    got = {tuple(x) for x in registry.queries()["movers_detect"](spark, DATA).collect()}
    feeds = defaultdict(lambda: defaultdict(dict))
    for x in spark.sql("SELECT p_brand AS feed, mint, d div 10 AS poll, sum(qty) AS v5 FROM trades JOIN part ON p_partkey = mint GROUP BY 1, 2, 3").collect():
        feeds[x.feed][x.poll][x.mint] = x.v5
    want = {(feed, p, m, v, why) for feed, pages in feeds.items() for p, m, v, why in plain(sorted(pages.items()), **RULES)}
    assert got == want and len(want) > 20


def test_alerts_of_a_stream_do_not_depend_on_how_it_is_cut(spark):
    r = random.Random(9)
    rows = [("ab"[m % 2], p, m, r.choice([5, 20, 45, 100, 300])) for p in range(40) for m in r.sample(range(20), 8)]
    pages = spark.createDataFrame(rows, "feed string, poll long, mint long, v5 long").withColumn("at", instant("poll"))
    cuts = [{tuple(x) for x in replayed(pages, "poll", lambda x: mover_alerts(x, Movers(**RULES)), "cut", n).collect()} for n in (1, 5)]
    assert cuts[0] == cuts[1] and cuts[0]


def test_only_launches_that_share_a_key_in_time_reach_the_stream(spark):
    from tidemark.operators import registry

    registry.queries()
    from tidemark.operators import machines

    launches = [(1, 10, "abcd", "t1"), (2, 11, "abcd", "t2"), (3, 12, "abce", "t3"), (4, 40, "abcd", "t1"), (5, 90, "zzzz", "t9"), (6, 92, "yyyy", "t9"), (7, 95, "xxxx", "t9")]
    spark.createDataFrame([(m, d, n, t, "x", "1") for m, d, n, t in launches], "mint long, d long, name string, p_brand string, p_type string, p_size string").createOrReplaceTempView("swarm_launches")
    got = sorted((x.kind, x.mint, x.name, x.d) for x in spark.sql(machines._KEYED).collect())
    # abcd and abce share one variant, abc; 4 and 7 come too late for any other.
    assert got == [("name", 1, "abcd", 10), ("name", 2, "abcd", 11), ("near", 1, "abcd", 10), ("near", 2, "abcd", 11), ("near", 3, "abce", 12), ("type", 5, "zzzz", 90), ("type", 6, "yyyy", 92)]
