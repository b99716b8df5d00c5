"""Accounting, resampling, models, machines and decoders against hand-worked rows and plain Python."""

import math
import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_whole_jobs import rows, write_calls, write_trades
from tidemark.functions import fitting, kernels
from tidemark.functions.machines import Band, Breaker, PaperBook
from tidemark.operators import registry
from tidemark.operators.decoding import base58_bytes, base58_text, borsh_event


def fifo(trades):
    """(owner, mint, slot, txi): matched, cost, tainted; by a queue of lots."""
    out, lots = {}, defaultdict(deque)
    for m, o, s, x, d, side, qty in sorted(trades, key=lambda t: (t[4], t[2], t[3])):
        q = lots[o, m]
        if side > 0:
            q.append([qty, 1000.0 * qty / qty])
            continue
        left, cost = qty, 0.0
        while left and q:
            take = min(left, q[0][0])
            cost += take * q[0][1]
            left -= take
            q[0][0] -= take
            if not q[0][0]:
                q.popleft()
        out[o, m, s, x] = (qty - left, cost, left > 0)
    return out


@pytest.fixture(scope="module")
def tape(tmp_path_factory):
    r = random.Random(3)
    trades = [(r.choice((1, 2)), r.choice((7, 8, 9)), i, 1, r.randrange(300), r.choice((1, 1, -1)), r.randrange(1, 20)) for i in range(200)]
    at = write_trades(tmp_path_factory.mktemp("accounts"), trades)
    write_calls(at, [(i, r.choice((1, 2)), r.randrange(300), 100.0 + i) for i in range(60)])
    return at, trades


def test_fifo_equals_a_queue_of_lots(spark, tape):
    at, trades = tape
    want = fifo(trades)
    got = {(r.owner, r.mint, r.slot, r.txi): (r.matched, r.cost_cents, r.basis_quality == "tainted") for r in rows(spark, "fifo_pnl", at)}
    assert set(got) == set(want) and any(w[2] for w in want.values())
    assert all(got[k][0] == w[0] and got[k][2] == w[2] and got[k][1] == pytest.approx(w[1], abs=0.02) for k, w in want.items())


def test_fifo_hand_worked(spark, tmp_path):
    # Two lots at 10 a unit, one sale over both and one beyond what is held.
    at = write_trades(tmp_path, [(1, 1, 1, 1, 0, 1, 4), (1, 1, 2, 1, 1, 1, 6), (1, 1, 3, 1, 2, -1, 5), (1, 1, 4, 1, 3, -1, 9), (1, 1, 5, 1, 4, 1, 2), (1, 1, 6, 1, 5, -1, 2)])
    got = [(r.slot, r.matched, r.cost_cents, r.realized_cents, r.basis_quality) for r in sorted(rows(spark, "fifo_pnl", at), key=lambda r: r.slot)]
    assert got == [(3, 5, 5000.0, 0.0, "exact"), (4, 5, 5000.0, 4000.0, "tainted"), (6, 2, 2000.0, 0.0, "exact")]


def test_average_cost_equals_the_recursion(spark, tape):
    at, trades = tape
    want, basis, episode, walk = {}, {}, Counter(), Counter()
    for m, o, s, x, d, side, qty in sorted(trades, key=lambda t: (t[4], t[2], t[3])):
        k, before = (o, m), max(walk[o, m], 0)
        if side > 0:
            if before == 0:
                episode[k] += 1
                basis[k] = 10.0
            else:
                basis[k] = (basis[k] * before + 10.0 * qty) / (before + qty)
        walk[k] += side * qty
        if episode[k]:
            want[o, m, s] = (episode[k], basis[k])
    got = {(r.owner, r.mint, r.slot): (r.episode, r.basis_after) for r in rows(spark, "avg_cost_basis_recursion", at)}
    assert set(got) == set(want) and all(got[k][0] == w[0] and got[k][1] == pytest.approx(w[1], abs=0.002) for k, w in want.items())


def test_walk_forward_counts_the_first_rule_that_a_sample_breaks(spark, tmp_path):
    r = random.Random(5)
    calls = [(i, r.randrange(12), r.randrange(600), 1.0) for i in range(103)]
    at = write_calls(tmp_path, calls)
    day, folds = 86400, 5
    s = sorted((d * day + 43200, i, m) for i, m, d, _ in calls)
    size = len(s) // folds
    for f in rows(spark, "walk_forward_split", at):
        test = s[f.fold * size : (f.fold + 1) * size if f.fold < folds - 1 else len(s)]
        start, mints, why = test[0][0], {m for _, _, m in test}, Counter()
        for t, _, m in s[: f.fold * size]:
            why["label" if t + 30 * day >= start else "embargo" if t > start - 7 * day else "entity" if m in mints else "train"] += 1
        assert (f.train, f.purged_by_label, f.embargoed, f.purged_by_entity) == (why["train"], why["label"], why["embargo"], why["entity"])


def test_curveball_keeps_degrees_and_moves(spark, tmp_path):
    trades = [(m, o, 1, 1, 0, 1, 1) for o in range(40) for m in random.Random(o).sample(range(60), 5 + o % 9)]
    at = write_trades(tmp_path, trades)
    before, after = {(o, m) for m, o, *_ in trades}, [(r.owner, r.mint) for r in rows(spark, "curveball_null", at)]
    assert len(after) == len(set(after)) == len(before) and set(after) != before
    for i in (0, 1):
        assert Counter(x[i] for x in after) == Counter(x[i] for x in before)


def test_block_permutation_and_placebos(spark, tape):
    at, trades = tape
    flow = Counter()
    for _, _, _, _, d, side, q in trades:
        flow[d] += side * q
    got = sorted((r.rn, r.from_d, r.x) for r in rows(spark, "block_permute", at))
    days = sorted(flow)
    assert len(got) == len(days) and all(flow[d] == x for _, d, x in got)
    place = [days.index(d) for _, d, _ in got]
    assert all((b - a) % len(days) == 1 for i, (a, b) in enumerate(zip(place, place[1:])) if (i + 1) % 20)
    calls = {r["call_id"]: r for r in spark.read.parquet(f"{at}/orders.parquet").selectExpr("o_orderkey AS call_id", "o_custkey AS mint", "datediff(o_orderdate, DATE'1995-01-01') AS d").collect()}
    by = defaultdict(list)
    for c in calls.values():
        by[c["mint"]].append(c["d"])
    for r in rows(spark, "placebo_windows", at):
        c = calls[r.call_id]
        assert r.t % 86400 == 43200 and 1 <= r.replicate <= 2 and all(abs(r.t // 86400 - d) >= 3 for d in by[c["mint"]])


def _design(n=3000, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    g = r.integers(0, 40, n)
    y = r.random(n) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - 0.2 * (x[:, 1] - 3) + 0.3 * r.normal(size=40)[g])))
    return x, y.astype(int), g


def test_logistic_and_its_clustered_errors_equal_numpy(spark):
    x, y, g = _design()
    df = spark.createDataFrame([(*map(float, a), int(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "a double, b double, c double, y int, g int").repartition(3)
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)])
    for l2 in (0.0, 2.0):
        beta, pen = np.zeros(4), np.diag([0, l2, l2, l2])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve((z.T * (p * (1 - p))) @ z + pen, z.T @ (y - p) - pen @ beta)
        got, bread, design = fitting.logistic(df, ["a", "b", "c"], "y", l2)
        assert np.allclose(got, beta, atol=1e-6)
    got, bread, design = fitting.logistic(df, ["a", "b", "c"], "y")
    p = 1 / (1 + np.exp(-z @ got))
    scores = np.array([(z[g == k] * (y - p)[g == k, None]).sum(0) for k in range(40)])
    inverse = np.linalg.inv((z.T * (p * (1 - p))) @ z)
    want = np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse) * 40 / 39 * (len(x) - 1) / (len(x) - 4))
    assert np.allclose(fitting.clustered(df, got, bread, design, "y", "g"), want, rtol=1e-5)
    assert fitting.logistic(df.withColumn("y", F.lit(1)), ["a"], "y")[0][1] == 0
    assert fitting.usable(df.withColumn("d", F.col("a") * -2).withColumn("e", F.lit(3)), ["a", "b", "d", "e"]) == [("a", "kept"), ("b", "kept"), ("d", "duplicate"), ("e", "constant")]


def test_cox_equals_numpy(spark):
    x, y, _ = _design(800, 2)
    t = np.random.default_rng(3).integers(1, 30, 800)
    df = spark.createDataFrame([(*map(float, a), int(b), int(c)) for a, b, c in zip(x, y, t, strict=True)], "a double, b double, c double, e int, t int")
    z, beta = (x - x.mean(0)) / x.std(0), np.zeros(3)
    for _ in range(20):
        r, grad, hess = np.exp(z @ beta), -0.1 * 800 * beta, 0.1 * 800 * np.eye(3)
        for u in np.unique(t[y == 1]):
            at, dead = t >= u, (t == u) & (y == 1)
            m = (r[at, None] * z[at]).sum(0) / r[at].sum()
            grad = grad + z[dead].sum(0) - dead.sum() * m
            hess = hess + dead.sum() * ((z[at].T * r[at]) @ z[at] / r[at].sum() - np.outer(m, m))
        beta = beta + np.linalg.solve(hess, grad)
    got, errors = fitting.cox(df, ["a", "b", "c"], "t", "e")
    assert np.allclose(got, beta, atol=1e-6) and np.allclose(errors, np.sqrt(np.diag(np.linalg.inv(hess))), rtol=1e-4)


def test_pooling(spark):
    r = np.random.default_rng(4)
    v = r.uniform(0.05, 0.5, 400)
    t = r.normal(1.0, 0.7, 400) + r.normal(size=400) * np.sqrt(v)
    mu, tau2 = t.mean(), max(((t - t.mean()) ** 2).mean() - v.mean(), 1e-9)
    for _ in range(2000):
        s, left = (tau2 * t + v * mu) / (tau2 + v), tau2 * v / (tau2 + v)
        mu, tau2 = s.mean(), ((s - s.mean()) ** 2).mean() + left.mean()
    got = fitting.partial_pool(spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, v, strict=True)], "t double, v double"), "t", "v")
    assert got[0] == pytest.approx(mu, abs=1e-4) and got[2] == pytest.approx(math.sqrt(tau2), abs=1e-3)


def test_machines():
    b = Breaker(window=3, most=10, pause=100)
    assert [b.close(p, t) for p, t in ((-4, 0), (-4, 1), (-4, 2), (-4, 3), (9, 4), (-20, 5))] == [False, False, True, False, False, True]
    assert b.until == 105 and b.paused(104) and not b.paused(105)
    book, got = PaperBook(), []
    for day, price in enumerate([10, 11, 11, 14, 14, 20, 20, 19, 17, 30, 30, 30, 30, 30, 40, 41, 20]):
        got.append(book.observe(day, float(price)))
    assert [g for g in got if g] == [(2, 3, 11.0, 14.0, "target"), (15, 16, 41.0, 20.0, "stop")]
    band = Band(0.5, 10)
    for day, price in zip([0, 10, 20, 30, 40], [1.0, 1.1, 3.0, 3.0, 3.1], strict=True):
        band.observe(day, price)
    assert (band.moves, band.inside) == (1, 20)


def test_decoders():
    for data in (b"", b"\0\0\1", bytes(range(32)), b"\xff" * 40):
        assert base58_bytes(base58_text(data)) == (data or None)
    assert base58_bytes("0") is None and base58_bytes(None) is None and base58_bytes("11", 3) is None and base58_bytes("111", 3) == b"\0\0\0"
    assert base58_text(b"hello world") == "StV1DL6CwTryKyV"
    assert borsh_event(None) is None and borsh_event(b"x" * 41) is None


def test_kernels_equal_plain_versions():
    x = np.array([1.0, -1, 2, 0, 5, 9, -7, 3, 3, 3])
    machine = kernels.RunLengths()
    r = [machine.step(v) for v in x]
    assert machine.left_out == 0
    # Every run length kept: the same posterior by an explicit table.
    table = {0: 1.0}
    for i, v in enumerate(x):
        joint = {}
        for run, p in table.items():
            past = x[i - run : i]
            var = 1 + 1 / (len(past) + 1)
            joint[run] = p * math.exp(-0.5 * (v - past.sum() / (len(past) + 1)) ** 2 / var) / math.sqrt(2 * math.pi * var)
        table = {0: 0.01 * sum(joint.values()), **{run + 1: 0.99 * p for run, p in joint.items()}}
        z = sum(table.values())
        table = {k: p / z for k, p in table.items()}
        assert r[i] == max(table, key=lambda k: (table[k], -k))
    assert kernels.clopper_pearson(3, 10) == pytest.approx((0.0667395, 0.6524529), abs=1e-6)
    assert kernels.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    swings = kernels.Swings(0.05)
    assert [swings.step(v) for v in (1, 1.1, 1.0, 1.2, 1.19)][-1] == 3
    some = kernels.RunLengths(keep=4)
    assert [some.step(v) for v in x][:3] == r[:3] and 0 < some.left_out < 1
    # A binomial tail of any size, against the sum of its terms.
    for k, n in ((1, 1), (0, 7), (7, 7), (2, 9), (40, 100), (3, 5000)):
        low, high = kernels.clopper_pearson(k, n)
        tail = lambda p, ks: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in ks)
        assert low == 0 if k == 0 else tail(low, range(k, n + 1)) == pytest.approx(0.025, abs=1e-7)
        assert high == 1 if k == n else tail(high, range(k + 1)) == pytest.approx(0.025, abs=1e-7)


def test_every_registered_query_names_itself_once():
    assert len(registry.queries()) >= 430 and set(registry.oracle_sql()) <= set(registry.queries())


def test_hodge_splits_known_flows():
    assert fitting.hodge([(0, 1, 2.0), (1, 2, 3.0), (0, 2, 5.0)]) == pytest.approx((1, 0, 0))
    assert fitting.hodge([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]) == pytest.approx((0, 1, 0))
    assert fitting.hodge([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0)]) == pytest.approx((0, 0, 1))
    assert fitting.hodge([]) == (0.0, 0.0, 0.0) and fitting.hodge([(1, 1, 4.0), (0, 1, 2.0), (1, 0, 2.0)]) == (0.0, 0.0, 0.0)


def test_boosting_splits_where_the_gain_is_largest(spark):
    r = np.random.default_rng(7)
    x = r.integers(0, 12, (4000, 2)).astype(float)
    y = (r.random(4000) < np.where(x[:, 0] > 6, 0.8, 0.2)).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int").repartition(3)
    trees = fitting.boosted(df, ["a", "b"], "y", trees=3, depth=1)
    g, h = y - 0.5, np.full(4000, 0.25)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((gain(x[:, f] <= e) + gain(x[:, f] > e), "ab"[f], float(e)) for f in (0, 1) for e in range(11)))
    assert trees[0][1] == best[1:] == ("a", 6.0)
    left = x[:, 0] <= 6
    assert trees[0][2] == pytest.approx(0.3 * g[left].sum() / (h[left].sum() + 1)) and trees[0][3] == pytest.approx(0.3 * g[~left].sum() / (h[~left].sum() + 1))
    got = df.select(F.avg(F.when(F.col("a") > 6, fitting.boosted_score(trees))).alias("hi"), F.avg(F.when(F.col("a") <= 6, fitting.boosted_score(trees))).alias("lo")).first()
    assert got.hi > 0.3 and got.lo < -0.3
    assert fitting.boosted(df.where("a > 100"), ["a"], "y", trees=1)[0] == {1: 0.0}
