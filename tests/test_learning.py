"""Online policies, the fitted point process and the replay over reserves, each against a plain version."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import hawkes
from tidemark.functions.bandits import POLICIES, Bandit, normals, uniforms
from tidemark.functions.folds import batches_of_keys, folded
from tidemark.functions.pool import DipPolicy, Replay, Reserves
from tidemark.operators import registry
from tidemark.operators.learning import CONTEXT, EXITS

DATA = "/root/testdata/sf0.001"


class Sums:
    def __init__(self, key):
        self.key, self.seen = key, []

    def feed(self, rows):
        self.seen += rows["v"].tolist()
        return [(self.key, v, False) for v in rows["v"] if v % 10 == 0]

    def end(self):
        return [(self.key, sum(i * v for i, v in enumerate(self.seen)), True)]


def test_folds_see_each_series_once_and_in_order(spark):
    r = random.Random(1)
    rows = [(k, t, r.randint(1, 99)) for k in range(40) for t in range(r.choice([1, 3, 50]))] + [(None, 0, 1)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(x) for x in folded(spark.createDataFrame(shuffled, "k long, t int, v long"), "k", ["t"], Sums, "k long, v long, last boolean").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {(k, v, False) for k, _, v in rows if k is not None and v % 10 == 0}
    want |= {(k, sum(i * v for i, v in enumerate(v for q, _, v in rows if q == k)), True) for k in range(40)}
    assert got == want
    assert folded(spark.createDataFrame([], "k long, t int, v long"), "k", ["t"], Sums, "k long, v long, last boolean").count() == 0


def test_stretches_of_keys_over_batches():
    frames = [pd.DataFrame({"k": [1, 1, 2]}), pd.DataFrame({"k": []}), pd.DataFrame({"k": [2, 2]}), pd.DataFrame({"k": [3]})]
    assert [(k, None if x is None else len(x)) for k, x in batches_of_keys(iter(frames), "k")] == [(1, 2), (1, None), (2, 1), (2, 2), (2, None), (3, 1), (3, None)]


def plain_bandit(policy, name, rounds, epsilon=0.1, alpha=0.5, scale=0.1):
    """Each round solves every arm's normal equations over all that is known by then."""
    arms, width, past, choices, gained = len(rounds[0][2]), len(rounds[0][1]), [], [], 0.0
    for n, (now, x, rewards, delays) in enumerate(rounds):
        a = np.stack([np.eye(width)] * arms)
        b = np.zeros((arms, width))
        for ready, arm, then, reward in past:
            if ready <= now:
                a[arm] += np.outer(then, then)
                b[arm] += reward * then
        mean = np.array([np.linalg.solve(a[k], b[k]) @ x for k in range(arms)])
        spread = np.array([math.sqrt(x @ np.linalg.solve(a[k], x)) for k in range(arms)])
        if policy == "epsilon":
            u = uniforms(f"{name}:{n}", 2)
            arm = int(u[1] * arms) if u[0] < epsilon else int(np.argmax(mean))
        else:
            arm = int(np.argmax(mean + (alpha * spread if policy == "linucb" else scale * spread * normals(f"{name}:{n}", arms))))
        past.append((now + delays[arm], arm, x, rewards[arm]))
        choices.append(arm)
        gained += rewards[arm]
    return choices, gained, sum(p[0] <= rounds[-1][0] for p in past[:-1])


@pytest.mark.parametrize("policy", POLICIES)
def test_policies_equal_a_plain_solution_of_each_round(policy):
    r = np.random.default_rng(3)
    truth = r.normal(size=(3, 4))
    rounds = []
    for n in range(120):
        x = np.append(r.normal(size=3), 1.0)
        rounds.append((float(n), x, truth @ x + r.normal(size=3) * 0.1, r.integers(0, 30, 3).astype(float)))
    b = Bandit(policy, 3, 4, "test")
    got = [b.round(*x) for x in rounds]
    choices, gained, known = plain_bandit(policy, "test", rounds)
    assert got == choices and b.gained == pytest.approx(gained) and b.updates == known
    assert sum(a == int(np.argmax(truth @ x[1])) for a, x in zip(got[60:], rounds[60:], strict=True)) > 40
    with pytest.raises(ValueError):
        Bandit("greedy", 2, 2, "x")


def test_draws_are_hashes_with_the_right_shape():
    u, z = uniforms("a", 4001), normals("b", 4000)
    assert len(u) == 4001 and 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and (normals("b", 4000) == z).all()


def test_bandit_query_equals_plain_policies(spark):
    got = {(x.owner, x.policy): x for x in registry.queries()["contextual_bandit"](spark, DATA).collect()}
    rows = spark.sql("SELECT *, ln(qty + 1) AS log_qty, CAST(1 AS DOUBLE) AS one FROM trades").toPandas().sort_values(["mint", "t", "slot", "txi", "owner"])
    for i, k in enumerate(EXITS):
        rows[f"reward{i}"] = np.log(rows.groupby("mint")["px"].shift(-k) / rows["px"])
        rows[f"delay{i}"] = rows.groupby("mint")["t"].shift(-k) - rows["t"]
    rows = rows[rows[f"reward{len(EXITS) - 1}"].notna()]
    for owner, x in list(rows.groupby("owner"))[:2]:
        x = x.sort_values(["t", "slot", "txi"])
        rounds = list(zip(x["t"].astype(float), x[CONTEXT].to_numpy(float), x[[f"reward{i}" for i in range(3)]].to_numpy(), x[[f"delay{i}" for i in range(3)]].to_numpy(float), strict=True))[:]
        for policy in POLICIES:
            _, gained, known = plain_bandit(policy, f"{policy}:{owner}", rounds)
            y = got[owner, policy]
            assert (y.rounds, y.updates) == (len(rounds), known) and y.reward == pytest.approx(gained, abs=1e-6)


def plain_loglik(seq, p):
    """All pairs of events."""
    mu, a, beta = p[:2], p[2:6].reshape(2, 2), p[6]
    end = max(t for t, _ in seq)
    out = -(end - seq[0][0]) * mu.sum()
    for i, (t, s) in enumerate(seq):
        rate = mu[s] + sum(a[s, z] * beta * math.exp(-beta * (t - u)) for u, z in seq[:i])
        out += math.log(rate) - a[:, s].sum() * (1 - math.exp(-beta * (end - t)))
    return out


def frames(sequences, size):
    rows = pd.DataFrame([(k, t, max(x for x, _ in seq), s) for k, seq in enumerate(sequences) for t, s in seq], columns=["key", "t", "last", "sell"])
    return iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)])


def test_hawkes_likelihood_equals_all_pairs_however_batches_are_cut():
    r = np.random.default_rng(5)
    sequences = [sorted((float(t), int(s)) for t, s in zip(r.uniform(0, 20, n), r.integers(0, 2, n), strict=True)) for n in (2, 40, 3, 17, 2)]
    points = np.exp(r.normal(size=(5, 7)) * 0.5 - 1)
    want = [sum(plain_loglik(seq, p) for seq in sequences) for p in points]
    for size in (1, 3, 10, 1000):
        assert hawkes.log_likelihoods(frames(sequences, size), points) == pytest.approx(want)


def simulated(r, p, horizon):
    """By thinning."""
    mu, a, beta = p[:2], p[2:6].reshape(2, 2), p[6]
    t, g, out = 0.0, np.zeros(2), []
    while True:
        bound = mu.sum() + beta * (a @ g).sum()
        wait = r.exponential(1 / bound)
        t, g = t + wait, g * math.exp(-beta * wait)
        if t > horizon:
            return out
        rate = mu + beta * (a @ g)
        u = r.uniform() * bound
        if u < rate.sum():
            s = 0 if u < rate[0] else 1
            out.append((t, s))
            g[s] += 1


def test_hawkes_fit_recovers_what_was_simulated(spark):
    r, truth = np.random.default_rng(6), np.array([0.2, 0.1, 0.4, 0.1, 0.2, 0.3, 2.0])
    sequences = [simulated(r, truth, 100.0) for _ in range(60)]
    events = spark.createDataFrame([(k, t, s) for k, seq in enumerate(sequences) for t, s in seq] + [(99, 1.0, 0)], "k long, t double, s int").repartition(5)
    found, value, n, many = hawkes.fit(events, "k", "t", "s", steps=150)
    assert n == sum(map(len, sequences)) and many == sum(len(x) > 1 for x in sequences)
    got = np.array([found[k] for k in hawkes.NAMES])
    assert abs(got[:2] / truth[:2] - 1).max() < 0.2 and abs(got[2:6] - truth[2:6]).max() < 0.1 and abs(got[6] / truth[6] - 1) < 0.25
    assert value >= hawkes.log_likelihoods(frames(sequences, 1000), truth[None])[0]
    with pytest.raises(ValueError):
        hawkes.fit(events.where("k = 99"), "k", "t", "s")


def test_simplex_finds_a_curved_valley():
    f = lambda x: 100 * (x[:, 1] - x[:, 0] ** 2) ** 2 + (1 - x[:, 0]) ** 2
    best, value = hawkes.simplex(f, np.array([-1.2, 1.0]), steps=300, tolerance=1e-12)
    assert value < 1e-8 and best == pytest.approx([1, 1], abs=1e-3)


def test_reserves_round_against_whoever_trades():
    p = Reserves(1000, 5000)
    assert p.cost(1000) is None and p.cost(999) == 5000 * 999
    cost = p.cost(10)
    assert cost == 51 and 5000 * 10 / 990 <= cost < 5000 * 10 / 990 + 1
    p.buy(10, cost)
    assert (p.tokens, p.money) == (990, 5051)
    paid = p.sell(10)
    assert paid == 5051 * 10 // 1000 and paid <= cost and (p.tokens, p.money) == (1000, 5051 - paid)


def plain_replay(slots, money, most):
    """Every slot with all of its state written out."""
    tokens = cash = None
    held = entry = since = 0
    before, log, cash = None, [], money
    for n, (reading, wanted) in enumerate(slots, 1):
        if reading:
            tokens, coins = reading
        if tokens is None:
            continue
        price = coins * 1_000_000 // tokens
        buys = not held and before is not None and wanted > 0 and 100 * price <= 97 * before
        sells = held and (100 * price >= 103 * entry or n - since >= 5)
        before = price
        amount = held if sells else wanted
        if (buys or sells) and amount > tokens * most // 10_000:
            log.append("large")
        elif sells:
            paid = coins * amount // (tokens + amount)
            tokens, coins, cash, held = tokens + amount, coins - paid, cash + paid, 0
            log.append(("sell", amount, paid))
        elif buys:
            cost = -(-coins * amount // (tokens - amount)) if amount < tokens else None
            if cost is None or cost > cash:
                log.append("refused")
            else:
                tokens, coins, cash, held, entry, since = tokens - amount, coins + cost, cash - cost, amount, price, n
                log.append(("buy", amount, cost))
    return cash, held, log


def test_replay_over_slots_without_readings_equals_a_plain_one():
    r, kinds = random.Random(7), set()
    for i in range(200):
        most, money = r.choice([200, 10_000]), r.choice([500, 10**6])
        slots = [((r.randint(500, 2000), r.randint(5000, 20_000)) if r.random() < 0.6 else None, r.choice([0, 5, 20, 100, 3000])) for _ in range(60)]
        replay = Replay(i, money, most, DipPolicy())
        replay.feed(pd.DataFrame({"tokens": [x[0] and x[0][0] for x in slots], "money": [x[0] and x[0][1] for x in slots], "wanted": [x[1] for x in slots]}))
        cash, held, log = plain_replay(slots, money, most)
        fills = [x for x in log if isinstance(x, tuple)]
        assert replay.end() == [(i, 60, len(fills), sum(x[2] for x in fills if x[0] == "buy"), sum(x[2] for x in fills if x[0] == "sell"), cash, held, log.count("refused"), log.count("large"))]
        kinds |= {x if isinstance(x, str) else x[0] for x in log}
    assert kinds == {"buy", "sell", "refused", "large"}


def test_replay_query_fills_and_refuses(spark):
    rows = registry.queries()["event_replay"](spark, DATA).collect()
    assert sum(x.fills for x in rows) > 50 and sum(x.too_large for x in rows) > 0 and all(x.cash == 5_000_000 + x.received - x.spent for x in rows)


def test_many_desks_at_once_equal_each_alone():
    from tidemark.functions.bandits import Desk, Desks

    r = np.random.default_rng(11)
    series = []
    for key, n in ((7, 1), (3, 60), (9, 25), (4, 60), (12, 140)):
        x = pd.DataFrame(r.normal(size=(n, 2)), columns=["a", "b"])
        x["t"] = np.sort(r.integers(0, n, n)).astype(float)
        for k in range(3):
            x[f"reward{k}"], x[f"delay{k}"] = r.normal(size=n) + k * x["a"], r.integers(0, 12, n).astype(float)
        series.append((key, x))
    want = {}
    for key, x in series:
        desk = Desk(key, 3, ["a", "b"])
        desk.feed(x)
        want |= {(key, p): (n, u, pytest.approx(g), pytest.approx(a)) for _, p, n, u, g, a in desk.end()}
    assert {(key, p): x for key, p, *x in map(list, Desks(3, ["a", "b"]).results(series))} == {k: list(v) for k, v in want.items()}


def test_a_series_longer_than_what_is_taken_together(spark, monkeypatch):
    from tidemark.functions import folds

    class Sum:
        def __init__(self, key):
            self._key, self._n = key, 0

        def feed(self, rows):
            self._n += len(rows)
            return []

        def end(self):
            return [(self._key, self._n, "alone")]

    df = spark.createDataFrame([(k, i) for k, n in ((1, 5), (2, 70), (3, 30), (4, 31), (5, 2)) for i in range(n)], "k long, i long")
    monkeypatch.setattr(folds, "TOGETHER", 30)
    parts = folds.batches_of_keys(iter([df.toPandas().sort_values(["k", "i"])]), "k")
    assert [k for k, p in parts if p is None] == [1, 2, 3, 4, 5]
    got = folds.folded_together(df, "k", ["i"], Sum, lambda s: [(k, len(x), "together") for k, x in s], "k long, n long, how string").collect()
    assert {(x.k, x.n, x.how) for x in got} == {(1, 5, "together"), (2, 70, "alone"), (3, 30, "together"), (4, 31, "alone"), (5, 2, "together")}
