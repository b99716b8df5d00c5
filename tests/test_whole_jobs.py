"""Operators on small tables whose rows an id filter, a modulo or a prefix would lose, against brute force."""

import datetime
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.operators import registry

BASE = datetime.date(1995, 1, 1)


def write_trades(at, trades):
    """trades: (mint, owner, slot, txi, d, side, qty)."""
    rows = [{"l_partkey": m, "l_suppkey": o, "l_orderkey": s, "l_linenumber": x, "l_shipdate": BASE + datetime.timedelta(days=d), "l_returnflag": "R" if side < 0 else "N", "l_quantity": float(q), "l_extendedprice": 10.0 * q, "l_linestatus": "O", "l_discount": 0.05, "l_tax": 0.0} for m, o, s, x, d, side, q in trades]
    pq.write_table(pa.Table.from_pylist(rows), f"{at}/lineitem.parquet")
    return str(at)


def write_calls(at, calls):
    """calls: (call_id, mint, d, price)."""
    pq.write_table(pa.Table.from_pylist([{"o_orderkey": c, "o_custkey": m, "o_orderdate": BASE + datetime.timedelta(days=d), "o_totalprice": p} for c, m, d, p in calls]), f"{at}/orders.parquet")
    return str(at)


def rows(spark, name, at):
    return registry.queries()[name](spark, at).collect()


@pytest.fixture(scope="module")
def tape(tmp_path_factory):
    r = random.Random(1)
    trades = [(r.choice((3, 43, 83, 500)), r.choice((5, 59, 60, 61, 700)), r.randrange(40), r.randrange(1, 8), r.randrange(900), r.choice((1, -1)), r.randrange(1, 50)) for _ in range(60)]
    return write_trades(tmp_path_factory.mktemp("tape"), trades), trades


def test_associative_array_holds_all_owners_and_real_mints(spark, tape):
    at, trades = tape
    a, b = Counter(), Counter()
    for m, o, _, x, _, side, q in trades:
        a[o, m] += side * q
        b[m, x] += q
    a = {k: v for k, v in a.items() if v}
    assert {(r.row, r.col): r.val for r in rows(spark, "assoc_transpose", at)} == {(m, o): v for (o, m), v in a.items()}
    product = Counter()
    for (o, m), v in a.items():
        for (n, x), w in b.items():
            product[o, x] += v * w if m == n else 0
    assert {(r.row, r.col): r.val for r in rows(spark, "matmul_plus_times", at)} == {k: v for k, v in product.items() if v}
    held = defaultdict(set)
    for o, m in a:
        held[o].add(m)
    pairs = {(p, q): len(held[p] & held[q]) / len(held[p] | held[q]) for p in held for q in held if p < q and held[p] & held[q]}
    assert {(r.row, r.col): r.val for r in rows(spark, "jaccard", at)} == pairs


def test_knn_takes_all_earlier_calls(spark, tmp_path):
    r = random.Random(2)
    calls = [(i, r.randrange(1, 400), r.randrange(300), float(r.randrange(1, 40)) * 1000) for i in range(1, 400)]
    got = {(x.call_id, x.rank_): x.a_id for x in rows(spark, "knn_topk", write_calls(tmp_path, calls))}
    want = {}
    for i, m, d, p in calls[19::20]:
        near = sorted((abs(p - q) / 1000 + abs(m - n), j) for j, n, e, q in calls if e < d)[:5]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


@pytest.mark.parametrize("places", [400, 1])
def test_knn_over_many_cells(spark, tmp_path, monkeypatch, places):
    from tidemark.functions import nearest

    monkeypatch.setattr(nearest, "CELL", 40)
    r = random.Random(3)
    calls = [(i, r.randrange(places), r.randrange(300), float(r.randrange(places)) * 1000) for i in range(600)]
    got = {(x.call_id, x.rank_): x.a_id for x in rows(spark, "knn_topk", write_calls(tmp_path, calls))}
    want = {}
    for i, m, d, p in calls[::20]:
        near = sorted((abs(p - q) / 1000 + abs(m - n), j) for j, n, e, q in calls if e < d)[:5]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_crew_matches_every_slot_by_its_whole_owner_set(spark, tape):
    at, trades = tape
    owners, day = defaultdict(set), {}
    for _, o, s, _, d, _, _ in trades:
        owners[s].add(o)
        day[s] = min(d, day.get(s, d))

    def jaccard(a, b):
        return len(owners[a] & owners[b]) / len(owners[a] | owners[b])

    best = {q: min((-jaccard(q, m), -len(owners[q] & owners[m]), m) for m in owners if m != q and len(owners[q] & owners[m]) >= 2) for q in owners if any(m != q and len(owners[q] & owners[m]) >= 2 for m in owners)}
    assert {r.q: (-r.jaccard, -r.overlap, r.m) for r in rows(spark, "crew_best_jaccard_join", at)} == best
    earlier = {q: [x for m in owners if day[m] < day[q] and (x := jaccard(q, m))] for q in owners}
    assert {r.q: r.best for r in rows(spark, "crew_best_match", at)} == {q: max(x) for q, x in earlier.items() if x}


def test_cycles_over_all_nodes(spark, tmp_path):
    r = random.Random(4)
    trades = [(r.randrange(55, 75), r.randrange(55, 75), i, 1, 5, 1, 3) for i in range(120)]
    legs = {(m, o) for m, o, *_ in trades if m != o}
    edges = {frozenset(x) for x in legs}
    nodes = sorted({x for e in legs for x in e})
    want = [(a, b, c) for a in nodes for b in nodes for c in nodes if a < b < c and {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= edges]
    want += [(a, b, None) for a, b in legs if a < b and (b, a) in legs]
    assert Counter(tuple(x) for x in rows(spark, "circuit_cycles", write_trades(tmp_path, trades))) == Counter(want)


def test_components_over_the_links_of_all_trades(spark, tape, tmp_path):
    at, trades = tape
    label = {x: x for m, o, *_ in trades for x in (o, 100000 + m)}
    for _ in label:
        for m, o, *_ in trades:
            label[o] = label[100000 + m] = min(label[o], label[100000 + m])
    assert {r.node: r.component for r in rows(spark, "union_find_components", at)} == label
    split = write_trades(tmp_path, [(1, 7, 1, 1, 5, 1, 3), (2, 7, 1, 2, 5, 1, 3), (3, 8, 2, 1, 5, 1, 3)])
    assert [tuple(r) for r in rows(spark, "largest_component", split)] == [(7, 3)]


def test_circular_shift_takes_every_shift_of_the_whole_series(spark, tape):
    at, trades = tape
    total = Counter()
    for _, _, _, _, d, side, q in trades:
        total[d] += side * q
    x = [total[d] for d in sorted(total)]
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x)
    want = {k: sum((v - mean) * (x[(i + k) % len(x)] - mean) for i, v in enumerate(x)) / var for k in range(1, len(x))}
    assert {r.shift: float(r.r) for r in rows(spark, "circular_shift_null", at)} == pytest.approx(want, abs=2e-6)


def test_analogs_take_all_of_train_and_validation(spark, tmp_path):
    r = random.Random(7)
    calls = [(i, r.randrange(1, 400), r.choice((30, 900, 1199, 1200, 1259, 1260, 1800)), float(r.randrange(1, 30))) for i in range(1, 300)]
    want = {}
    for i, m, d, p in calls:
        if d >= 1260:
            near = sorted((abs(p - q), i // 40 != j // 40, j) for j, n, e, q in calls if e < 1200)[:3]
            want |= {(i, k + 1): x[2] for k, x in enumerate(near)}
    assert {(x.call_id, x.rank_): x.a_id for x in rows(spark, "descriptive_analogs", write_calls(tmp_path, calls))} == want


def test_gaps_and_snapshots_of_every_mint(spark, tape):
    at, trades = tape
    days, snaps = defaultdict(set), defaultdict(set)
    for m, _, _, _, d, _, _ in trades:
        days[m].add(d)
        snaps[m].add(d // 100)
    gaps = {(m, a, b) for m, x in days.items() for a, b in zip(sorted(x), sorted(x)[1:]) if b - a > 3}
    assert {(r.mint, r.d, r.nxt) for r in rows(spark, "gap_detect_lead", at)} == gaps
    absent = {(m, d) for m, x in days.items() for d in range(min(x), max(x)) if d not in x}
    assert {(r.mint, r.d) for r in rows(spark, "anti_join_via_null", at)} == absent
    board = {(m, s, s - 1 not in x, s + 1 not in x) for m, x in snaps.items() for s in x}
    assert {(r.mint, r.snap, r.enters, r.leaves) for r in rows(spark, "board_watcher", at)} == board


def test_chains_of_any_length(spark, tmp_path):
    r = random.Random(5)
    trades = [(r.randrange(9), r.randrange(9), s, x, 10, 1, r.choice((0.3, 1, 2, 7))) for s, n in ((1, 1), (2, 17), (3, 18), (4, 70), (None, 20)) for x in range(1, n + 1)]
    got = {(x.slot, x.txi): x.place for x in rows(spark, "slot_chain_order", write_trades(tmp_path, trades))}
    assert got == {(s, x): x - 1 for _, _, s, x, *_ in trades}


def test_burst_pairs_in_order_and_across_batches(spark, tmp_path):
    r = random.Random(8)
    trades = [(r.choice((1, 2, 2, 2, 9)), r.choice((5, 6, 7)), s, 1, r.randrange(300), 1, 1) for s in range(400)] + [(3, 5, 1000, 1, 0, 1, 1), (3, None, 1001, 1, 40, 1, 1)]
    near = sum(1 for i, x in enumerate(trades) for y in trades[:i] if x[0] == y[0] and None not in (x[1], y[1]) and x[1] != y[1] and abs(x[4] - y[4]) <= 20)
    at = write_trades(tmp_path, trades)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = registry.queries()["burst_null"](spark, at)
        assert {x.kind: x.observed for x in df.collect()} == {"envelope": near, "uniform": near}
        from tidemark.operators import replans

        # Draws stay in the rows that they are made of: no exchange holds them, and no join pairs them.
        plan = replans._burst_pairs(spark, at, False)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Generate") < plan.index("Repartition")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
    assert {tuple(x) for x in df.collect()} == set(con.execute(registry.oracle_sql()["burst_null"]).fetchall())


def test_absent_days_are_made_after_the_sort(spark, tmp_path):
    trades = [(m, 1, 1, 1, d, 1, 1) for m, x in ((1, (0, 1, 4, 4, 9)), (2, (7,)), (3, (2, 3)), (None, (5, 8))) for d in x]
    at = write_trades(tmp_path, trades)
    df = registry.queries()["anti_join_via_null"](spark, at)
    assert {(x.mint, x.d) for x in df.collect()} == {(1, 2), (1, 3), (1, 5), (1, 6), (1, 7), (1, 8), (None, 5), (None, 6), (None, 7), (None, 8)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Window")


def test_draws_of_a_scene_whose_cut_misses_the_band(spark, tmp_path, monkeypatch):
    registry.queries()
    from tidemark.operators import replans

    r = random.Random(9)
    trades = [(m, r.randrange(5), s, 1, r.randrange(12), r.choice((1, -1)), r.randrange(1, 9)) for s in range(900) for m in [r.randrange(150)]]
    at = write_calls(tmp_path, [(i, r.randrange(200), r.randrange(12), 1.0) for i in range(300)])
    write_trades(tmp_path, trades)
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()["selection_score"]).fetchall()
    # In a band of no width nearly every cut misses, and all draws of those scenes are sorted.
    for band in (replans.SCORE_BAND, 0.0):
        monkeypatch.setattr(replans, "SCORE_BAND", band)
        assert [tuple(x) for x in rows(spark, "selection_score", at)] == want
