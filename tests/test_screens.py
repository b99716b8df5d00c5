"""Choice models, compression distances, the recorder, reachability and projections against plain versions."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import choice, distance
from tidemark.functions.graph import reachable
from tidemark.operators import registry
from tidemark.operators.recording import decoded, tape
from tidemark.operators.screens import MODELS
from tidemark.sources.scratch import path
from tidemark.streaming.recorder import record

DATA = "/root/testdata/sf0.001"


def sets(seed, n=150):
    r = np.random.default_rng(seed)
    rows, beta = [], np.array([1.2, -0.7])
    for s in range(n):
        x = r.normal(size=(r.integers(2, 6), 2))
        p = np.exp(x @ beta)
        pick = r.choice(len(x), p=p / p.sum())
        rows += [(s, bool(j == pick), float(a), float(b), float(r.normal())) for j, (a, b) in enumerate(x)]
    return rows + [(9_000, False, 1.0, 1.0, 1.0), (9_001, True, 0.0, 0.0, 0.0), (9_001, True, 1.0, 2.0, 0.0)]


def plain_value(rows, names, beta):
    """Log likelihood, gradient and negative Hessian set by set."""
    at = {"a": 2, "b": 3, "c": 4}
    value, gradient, hessian, n = 0.0, np.zeros(len(names)), np.zeros((len(names),) * 2), 0
    for s in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == s]
        if sum(r[1] for r in members) != 1:
            continue
        n += 1
        x = np.array([[r[at[c]] for c in names] for r in members])
        p = np.exp(x @ beta)
        p /= p.sum()
        k = next(i for i, r in enumerate(members) if r[1])
        value += np.log(p[k])
        gradient += x[k] - p @ x
        hessian += (x.T * p) @ x - np.outer(p @ x, p @ x)
    return n, value, gradient, hessian


def test_choice_models_equal_a_plain_fit(spark):
    rows = sets(1)
    df = spark.createDataFrame(rows, "s long, chosen boolean, a double, b double, c double").repartition(4)
    models = {"one": ["a"], "two": ["a", "b"], "noise": ["c"], "all": ["a", "b", "c"]}
    betas = {m: np.linspace(0.3, -0.2, len(x)) for m, x in models.items()}
    n, got = choice.evaluate(df, "s", "chosen", models, betas)
    for m, x in models.items():
        want = plain_value(rows, x, betas[m])
        assert n == want[0] == 150 and got[m][0] == pytest.approx(want[1]) and got[m][1] == pytest.approx(want[2]) and got[m][2] == pytest.approx(want[3])
    found = choice.fit(df, "s", "chosen", models)
    for m, x in models.items():
        _, value, gradient, _ = plain_value(rows, x, found[m])
        assert np.abs(gradient).max() < 1e-3
        for step in np.eye(len(x)) * 0.05:
            assert plain_value(rows, x, found[m] + step)[1] < value > plain_value(rows, x, found[m] - step)[1]
    later = sets(2)
    held = {m: plain_value(later, x, found[m])[1] for m, x in models.items()}
    assert max(held, key=held.get) in ("two", "all") and held["two"] > held["one"] > held["noise"]


def test_screen_query_uses_only_what_was_known(spark):
    rows = {x.model: x for x in registry.queries()["response_kernel_screen"](spark, DATA).collect()}
    assert set(rows) == set(MODELS) and sorted(x["rank"] for x in rows.values()) == [1, 2, 3, 4]
    order = sorted(rows.values(), key=lambda x: x["rank"])
    assert all(a.log_likelihood >= b.log_likelihood for a, b in zip(order, order[1:], strict=False))
    raw = spark.sql("SELECT slot, d, mint, owner, txi, px, qty, discount, tax FROM trades").toPandas().sort_values(["mint", "d", "slot", "txi", "owner"])
    raw["rise"] = np.log(raw.groupby("mint")["px"].shift(-1) / raw["px"])
    raw["known"] = raw.groupby("mint")["d"].shift(-1)
    raw = raw[raw["rise"].notna()]
    train, later = [], []
    for slot, x in raw.groupby("slot"):
        if len(x) < 2:
            continue
        best = x.sort_values(["rise", "txi", "owner"], ascending=[False, True, True]).index[0]
        put = train if x["known"].max() < 1200 else later if x["d"].min() >= 1200 else []
        put += [(slot, bool(i == best), float(np.log(v.px)), float(np.log(v.qty + 1)), 0.0) for i, v in x.iterrows()]
    x = rows["price"]
    assert x.fitted_sets == len({r[0] for r in train}) and x.held_out_sets == len({r[0] for r in later})
    assert x.log_likelihood == pytest.approx(plain_value(later, ["a"], np.array(x.weights))[1] / x.held_out_sets, abs=1e-4)
    assert abs(plain_value(train, ["a"], np.array(x.weights))[2][0]) < 0.05


def test_compression_distances_of_candidates(spark):
    r = random.Random(3)
    alphabet = [a + b + c for a in "BS" for b in "ABC" for c in "ab"]
    series = {i: [r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40]))] for i in range(40)}
    series[50] = series[3][:20] + series[7][:20]
    series[51] = series[50][:]
    items = spark.createDataFrame([(i, d, d, 0, s) for i, x in series.items() for d, s in enumerate(x)], "item long, d long, slot long, txi int, symbol string")
    grams = {i: {"".join(x[k : k + 3]) for k in range(len(x) - 2)} for i, x in series.items()}
    n = Counter(g for x in grams.values() for g in x)
    shared = {(a, b): sum(2 <= n[g] <= distance.RARE for g in grams[a] & grams[b]) for a in grams for b in grams if a < b}
    shared = {k: v for k, v in shared.items() if v >= distance.SHARED}
    pairs = distance.candidate_pairs(items)
    assert {(x.a, x.b): x.shared for x in pairs.collect()} == shared and (50, 51) in shared
    size = lambda s: len(zlib.compress("".join(s).encode(), 9))
    got = distance.compression_distances(items, pairs)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    rows = got.collect()
    assert len(rows) == len(shared)
    for x in rows:
        a, b, ab = size(series[x.a]), size(series[x.b]), size(series[x.a] + series[x.b])
        assert (x.size_a, x.size_b, x.size_ab) == (a, b, ab) and x.distance == pytest.approx((ab - min(a, b)) / max(a, b))
    assert min(rows, key=lambda x: x.distance).b in (50, 51)


def feed(spark, at, rows, mode="append"):
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.mode(mode).text(at)


def line(i, kind="view", k=5):
    return f'{{"event_id":{i},"user_id":{i % 3},"kind":"{kind}","t":{i},"props":"{{\\"k\\": {k}}}"}}'


def contents(spark, recorder):
    names = {"tape": ["event_id", "user_id", "kind", "t", "k"], "watches": ["user_id", "opened", "event_id"], "defects": ["value"]}
    return {n: Counter(tuple(x) for x in recorder.table(spark, n).select(c).collect()) for n, c in names.items()} | {"ledger": Counter(tuple(x) for x in recorder.ledger(spark).select("seen", "failed", "defects", "without_payload").collect())}


def test_a_batch_recorded_again_changes_nothing(spark):
    source, at = path(spark, "feed"), path(spark, "recorded")
    recorder, lines = tape(at), lambda: decoded(spark.readStream.text(source))
    feed(spark, source, [line(1), line(2, "signup", 7), line(3, "error"), '{"event_id":', "", line(4, "click", '\\"x\\"')])
    record(lines(), recorder, f"{at}-checkpoint")
    first = contents(spark, recorder)
    assert first["tape"] == Counter({(1, 1, "view", 1, 5): 1, (2, 2, "signup", 2, 7): 1, (4, 1, "click", 4, None): 1})
    assert first["watches"] == Counter({(2, 2, 2): 1}) and sum(first["defects"].values()) == 2 and first["ledger"] == Counter({(6, 1, 2, 1): 1})
    # The same batch by hand, and from a checkpoint that was lost: its number is in the ledger.
    batch = decoded(spark.createDataFrame([(line(1),), (line(9),)], "value string"))
    recorder(batch, 0)
    record(lines(), recorder, f"{at}-lost-checkpoint")
    assert contents(spark, recorder) == first
    feed(spark, source, [line(10, "signup")])
    record(lines(), recorder, f"{at}-checkpoint")
    later = contents(spark, recorder)
    assert later["tape"] - first["tape"] == Counter({(10, 1, "signup", 10, 5): 1}) and sum(later["ledger"].values()) == 2


def test_a_batch_that_failed_half_way_is_not_seen_and_is_written_whole_later(spark):
    at = path(spark, "half")
    good = tape(at)
    rows = decoded(spark.createDataFrame([(line(i, "signup"),) for i in range(5)], "value string"))
    good(rows, 0)
    before = contents(spark, good)

    def breaks(x):
        parts = good._split(x)
        return {"tape": parts["tape"], "watches": parts["watches"].where(F.raise_error(F.lit("lost")).isNull())}

    later = decoded(spark.createDataFrame([(line(i, "signup"),) for i in range(5, 9)], "value string"))
    broken = type(good)(at, breaks, good._counts)
    with pytest.raises(Exception, match="lost"):
        broken(later, 1)
    assert contents(spark, good) == before
    good(later, 1)
    after = contents(spark, good)
    assert sum(after["tape"].values()) == 9 and max(after["tape"].values()) == 1 and sum(after["watches"].values()) == 9


def test_reachable_equals_a_plain_closure(spark):
    r = random.Random(2)
    graphs = [[(i, i + 1) for i in range(40)], [(r.randint(0, 25), r.randint(0, 25)) for _ in range(35)], [(1, 2), (2, 1), (2, 3), (3, 3), (None, 5), (4, None)]]
    for edges in graphs:
        for roots in ([0, 7], [1], []):
            seen, todo = set(roots), list(roots)
            while todo:
                x = todo.pop()
                for a, b in edges:
                    if a == x and b is not None and b not in seen:
                        seen.add(b)
                        todo.append(b)
            got = reachable(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(x,) for x in roots] * 2, "node long"))
            rows = [x.node for x in got.collect()]
            assert sorted(rows) == sorted(seen)


def test_projections_conserve_what_goes_in_and_out(spark):
    add = registry.queries()["lp_add_projection"](spark, DATA)
    calls = {x.call_id: x for x in spark.sql("SELECT call_id, CAST(floor(price * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(price / 1000) AS BIGINT) AS tokens FROM calls").collect()}
    sums = add.groupBy("call_id").agg(F.sum("add_x").alias("x"), F.sum("add_y").alias("y"), F.count_if("is_active").alias("n")).collect()
    assert sums and all((x.x, x.y, x.n) == (calls[x.call_id].tokens, calls[x.call_id].cents, 1) for x in sums)
    assert {x.refusal for x in add.select("refusal").distinct().collect()} >= {None, "deposit_rounds_to_zero"}
    out = registry.queries()["lp_remove_projection"](spark, DATA)
    held = duckdb.connect()
    held.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    pools = dict(held.execute("SELECT l_partkey, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) FROM lineitem WHERE l_quantity > 0 GROUP BY 1").fetchall())
    for x in out.groupBy("mint").agg(F.sum("y_out").alias("y")).collect():
        assert x.y <= pools[x.mint]
    rows = out.collect()
    assert all(x.removed >= 0 and x.remaining >= 0 for x in rows) and {x.refusal for x in rows} == {None, "removal_rounds_to_zero", "close_would_leave_liquidity"}
    assert all(x.remaining == 0 and x.refusal is None for x in rows if x.owner % 10 == 0)
