"""Queries that SQL cannot express, on the smallest tables, against plain loops over the same rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest


from tidemark.functions.nearest import nearest_by_value
from tidemark.operators import registry

DATA = "/root/testdata/sf0.001"
ORDER = ["d", "slot", "txi", "owner", "cents"]


@pytest.fixture(scope="module")
def series(spark):
    registry.queries()["cusum_trace"](spark, DATA)  # registers the tape's relations
    rows = spark.sql("SELECT * FROM trades").toPandas().sort_values(["mint", *ORDER])
    return {mint: x for mint, x in rows.groupby("mint")}


def collected(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def test_cusum_trace(spark, series):
    got = defaultdict(Counter)
    for r in collected(spark, "cusum_trace"):
        got[r.mint][r.slot, r.txi, round(r.cusum, 6)] += 1
    assert set(got) == set(series)
    for mint, x in series.items():
        moved = np.diff(x["px"], prepend=x["px"].iloc[0])
        high = low = 0.0
        want = Counter()
        for i, (slot, txi) in enumerate(zip(x["slot"], x["txi"], strict=True)):
            sd = moved[:i].std(ddof=1) if i > 1 else 0.0
            z = (moved[i] - moved[:i].mean()) / sd if sd > 0 else 0.0
            high, low = max(0.0, high + z - 0.5), max(0.0, low - z - 0.5)
            want[slot, txi, round(max(high, low), 6)] += 1
            if max(high, low) > 5:
                high = low = 0.0
        assert sum((got[mint] - want).values()) <= 1  # a last digit


def test_e_detector_and_swings(spark, series):
    e = {r.mint: r.e_value for r in collected(spark, "e_detector")}
    swings = {r.mint: r.swings for r in collected(spark, "wiggle_count")}
    assert set(e) == set(swings) == set(series)
    for mint, x in series.items():
        bets = (x["delta"] > 0).tolist()
        # The detector's value sums the wealth of bettors who began at each time.
        best, wealth = 0.0, []
        for i, b in enumerate(bets):
            p = min(max((1 + sum(bets[:i])) / (i + 2), 0.01), 0.99)
            wealth = [w * (p if b else 1 - p) / 0.5 for w in [*wealth, 1.0]]
            best = max(best, sum(wealth))
        assert e[mint] == pytest.approx(best)
        n, up, low, high = 0, None, math.inf, -math.inf
        for v in x["px"]:
            low, high = min(low, v), max(high, v)
            if up is not True and v >= 1.02 * low:
                n, up, high = n + 1, True, v
            elif up is not False and v <= 0.98 * high:
                n, up, low = n + 1, False, v
        assert swings[mint] == n


def closes(x):
    x = x.groupby("d").last()
    return list(zip(x.index.tolist(), x["px"].tolist(), strict=True))


def test_mint_book_and_policy_frontier(spark, series):
    books = defaultdict(list)
    for r in collected(spark, "mint_book_state_machine"):
        books[r.mint].append((r.opened, r.closed, r.why))
    bands = {(r.mint, r.half_width, r.dwell): (r.moves, r.inside_days) for r in collected(spark, "policy_frontier_sweep")}
    for mint, x in series.items():
        path = closes(x.sort_values(["d", "slot", "txi", "owner", "cents"]))
        want, i, free = [], 1, -(10**9)
        while i < len(path):
            if path[i][1] >= 1.05 * path[i - 1][1] and path[i][0] >= free and i + 1 < len(path):
                opened, entry = path[i + 1]
                for j in range(i + 2, len(path)):
                    d, p = path[j]
                    why = "target" if p >= 1.2 * entry else "stop" if p <= 0.9 * entry else "deadline" if d >= opened + 60 else None
                    if why:
                        want.append((opened, d, why))
                        free = d + 10
                        break
                else:
                    break
                i = j + 1
            else:
                i += 1
        assert sorted(books[mint]) == sorted(want)
        for (width, dwell) in ((0.25, 0), (1.0, 30)):
            center, away, moves, inside = math.log(path[0][1]), None, 0, 0
            for k, (d, p) in enumerate(path):
                if abs(math.log(p) - center) <= width:
                    away = None
                    inside += path[k + 1][0] - d if k + 1 < len(path) else 0
                else:
                    away = d if away is None else away
                    if d - away >= dwell:
                        center, away, moves = math.log(p), None, moves + 1
            assert bands[mint, width, dwell] == (moves, inside)


def test_hawkes_em_likelihood_is_at_a_top(spark, series):
    found = {r.mint: r for r in collected(spark, "hawkes_em")}

    def value(times, mu, a, b):
        out, g = -mu * (times[-1] - times[0]) - a * len(times), 0.0
        for i, t in enumerate(times):
            g = (g + 1) * math.exp(-b * (t - times[i - 1])) if i else 0.0
            out += math.log(mu + a * b * g)
        return out

    for mint, x in list(series.items())[:20]:
        r, times = found[mint], np.sort(x["t"].to_numpy() / 86400.0)
        assert r.mu > 0 and 0 <= r.branching < 1 and r.beta > 0
        start = len(times) / (2 * (times[-1] - times[0]))
        assert value(times, r.mu, r.branching, r.beta) >= value(times, start, 0.5, 1.0) - 1e-9


def test_circuit_breaker(spark):
    got = defaultdict(dict)
    for r in collected(spark, "circuit_breaker"):
        got[r.user_id][r.event_id] = (r.during_pause, r.trips, r.paused_until)
    rows = spark.read.parquet(f"{DATA}/events.parquet").where("event_type IN ('purchase', 'error')").selectExpr("user_id", "event_id", "event_type", "value", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS t").toPandas()
    assert sum(map(len, got.values())) == len(rows)
    for user, x in rows.sort_values(["t", "event_id"]).groupby("user_id"):
        last, until = [], 0
        for e, kind, v, t in zip(x["event_id"], x["event_type"], x["value"], x["t"], strict=True):
            paused = t < until
            last = (last + [math.floor(v) if kind == "purchase" else -60])[-10:]
            trips = sum(last) < -120
            if trips:
                last, until = [], max(until, t + 86400)
            assert got[user][e] == (paused, trips, until)


def test_entity_resolve(spark):
    got = {r.wallet: r.entity for r in collected(spark, "entity_resolve")}
    parent = {w: w for w in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(group):
        group = sorted(set(group))
        for w in group[1:]:
            parent[find(w)] = find(group[0])

    first = spark.sql("SELECT o_custkey AS funded, min_by(c_nationkey, struct(t, call_id)) AS funder FROM calls JOIN orders ON o_orderkey = call_id JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey").toPandas()
    for _, x in first.groupby("funder"):
        if len(x) <= 40:
            join(x["funded"])
    for _, x in spark.sql("SELECT slot, mint, owner FROM trades").toPandas().groupby(["slot", "mint"]):
        if len(x) <= 5:
            join(x["owner"])
    least = {}
    for w in sorted(got):
        least.setdefault(find(w), w)
    assert got == {w: least[find(w)] for w in got} and len(set(got.values())) < len(got)


def test_usable_columns_and_logistic_sklearn(spark):
    assert {r.column_: r.verdict for r in collected(spark, "usable_columns")} == {"discount": "kept", "tax": "kept", "qty": "kept", "log_px": "kept", "twice": "duplicate", "same": "constant"}
    x = spark.sql("SELECT d, CASE WHEN side = -1 THEN 1 ELSE 0 END AS y, discount, tax, qty, ln(px) AS log_px FROM trades").toPandas()
    names = ["discount", "tax", "qty", "log_px"]
    train = x[x["d"] < 1200]
    center, spread = train[names].astype(float).mean().to_numpy(), train[names].astype(float).std(ddof=0).to_numpy()
    design = lambda x: np.column_stack([np.ones(len(x)), (x[names].astype(float).to_numpy() - center) / spread])
    a, y, beta = design(train), train["y"].to_numpy(), np.zeros(5)
    penalty = np.diag([0.0, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve((a.T * (p * (1 - p))) @ a + penalty, a.T @ (y - p) - penalty @ beta)
    later = x[x["d"] >= 1200]
    score = 1 / (1 + np.exp(-design(later) @ beta))
    want = {int(k): (int((np.floor(score * 10) == k).sum()), int(later["y"][np.floor(score * 10) == k].sum())) for k in set(np.floor(score * 10))}
    rows = collected(spark, "logistic_sklearn")
    assert {r.tenth: (r.n, r.positive) for r in rows} == want
    for r in rows:
        assert r.mean_score == pytest.approx(score[np.floor(score * 10) == r.tenth].mean(), abs=1e-4)


def test_nearest_by_value_with_ties_and_repeated_values(spark):
    import random

    r = random.Random(4)
    pool = [(i, float(r.choice([1, 2, 2, 3, 5, 8, 8, 8, 13, 40, r.randint(0, 60)])), r.randint(0, 2)) for i in range(150)]
    asked = [(1000 + i, float(r.randint(-5, 65)) + r.choice([0, 0.5]), r.randint(0, 3)) for i in range(60)] + [(1000, 8.0, 1)]
    for k in (1, 4):
        got = nearest_by_value(spark.createDataFrame(asked[:60], "id long, value double, kind int"), spark.createDataFrame(pool, "a_id long, a_value double, a_kind int"), k)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        rows = {(x.id, x.rank_): (x.a_id, x.far) for x in got.collect()}
        want = {}
        for i, v, kind in asked[:60]:
            for n, (far, _, a) in enumerate(sorted((abs(v - b), kind != c, a) for a, b, c in pool)[:k]):
                want[i, n + 1] = (a, far)
        assert rows == want
    few = nearest_by_value(spark.createDataFrame(asked[:3], "id long, value double, kind int"), spark.createDataFrame(pool[:2], "a_id long, a_value double, a_kind int"), 5)
    assert few.count() == 6
    assert nearest_by_value(spark.createDataFrame(asked[:3], "id long, value double, kind int"), spark.createDataFrame([], "a_id long, a_value double, a_kind int"), 5).count() == 0


def test_quantile_approx_is_near_the_exact_one(spark, series):
    prices = defaultdict(list)
    for x in series.values():
        for status, px in zip(x["status"], x["px"], strict=True):
            prices[status].append(px)
    for r in collected(spark, "quantile_approx"):
        x = np.sort(prices[r.status])
        for q, v in zip((0.25, 0.5, 0.75), r.quartiles, strict=True):
            assert abs(np.searchsorted(x, v) / len(x) - q) < 0.005


def test_nearest_by_value_over_many_ranges(spark, monkeypatch):
    import random

    from tidemark.functions import nearest

    monkeypatch.setattr(nearest, "RANGE", 12)
    r = random.Random(6)
    pool = [(i, float(r.choice([2, 2, 8, r.randint(0, 90), r.randint(0, 9)])), r.choice((0, 1, 2, None)), i % 7) for i in range(300)]
    asked = [(1000 + i, float(r.randint(-5, 95)) + r.choice([0, 0.5]), r.choice((0, 1, 2, 3, None))) for i in range(150)]
    for k in (1, 5):
        got = nearest_by_value(spark.createDataFrame(asked, "id long, value double, kind int"), spark.createDataFrame(pool, "a_id long, a_value double, a_kind int, n long"), k, ("n",))
        want = {}
        for i, v, kind in asked:
            for place, (far, _, a, n) in enumerate(sorted((abs(v - b), kind is None or kind != c, a, n) for a, b, c, n in pool)[:k]):
                want[i, place + 1] = (a, far, n)
        assert {(x.id, x.rank_): (x.a_id, x.far, x.n) for x in got.collect()} == want
