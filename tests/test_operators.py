"""Registered queries against their SQL on the smallest tables, and helpers against hand-worked cases."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import assoc
from tidemark.functions.graph import components, hop_levels
from tidemark.functions.intervals import interval_subtract, interval_union
from tidemark.functions.joins import asof_join, range_join
from tidemark.functions.ranks import numbered, quantiles, ranks, running, tiles
from tidemark.operators import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["minute_bars", "asof_join_backward", "temporal_prebuy_join", "interval_subtract", "auc_rank", "kaplan_aalen_johansen", "matmul_max_plus", "union_find_components", "fifo_pnl", "watch_ledger", "benjamini_yekutieli", "crew_best_jaccard_join"]
#: Queries whose SQL has another form than their plan.
SOME += ["walk_forward_split", "archive_outcomes", "deadline_heap", "quality_priced_panel", "hawkes_intensity", "evaluate_position_rules", "slot_chain_order", "moving_block_halves", "pool_tape_aggregate", "dataset_materialize", "crime_features", "shared_template_groups", "sign_test", "hop_levels", "keyset_pagination", "jsonl_tail", "base58_decode", "borsh_decode", "canonical_json_digest", "sqlite_scan", "midrank", "rank_ties", "operator_iceberg_fdr", "decile_contrast", "top10_delta", "co_trade_slot_window_join", "selection_outcomes", "callout_peak_multiple", "onchain_features_at_call", "burst_statistic", "analog_knn_model", "verdict_survival_km", "swarm_detector", "event_replay", "tape_recorder", "retention_report", "lp_add_projection", "lp_remove_projection", "response_exposure_windows", "wallet_tx_import", "frame_classify", "mover_page_parse", "parse_candles", "dossier_crew_join", "tape_audit", "as_known_catalog", "overlap_check", "both_edges_touch", "buy_call_sell_choreography", "signature_volatility_wall"]


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(same(r[names.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(same(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want


def test_running_totals_and_tiles_span_ranges(spark):
    rows = [(v, i) for i, v in enumerate([5, 1, 5, 3, 3, 9, 0, 5, 2, 7] * 20)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(3)
    order = sorted(range(len(rows)), key=lambda k: rows[k])
    upto, total, low = {}, 0, {}
    for n, k in enumerate(order, 1):
        total += rows[k][0]
        upto[k] = (n, total)
    least = None
    for k in reversed(order):
        least = rows[k][1] if least is None else min(least, rows[k][1])
        low[k] = least
    assert {r.i: r.rn for r in numbered(df, ["v", "i"]).collect()} == {rows[k][1]: n for k, (n, _) in upto.items()}
    assert {r.i: r.s for r in running(df, ["v", "i"], F.col("v"), "s").collect()} == {rows[k][1]: t for k, (_, t) in upto.items()}
    assert {r.i: r.m for r in running(df, [F.desc("v"), F.desc("i")], F.col("i"), "m", "min").collect()} == {rows[k][1]: v for k, v in low.items()}
    by = {r.v: (r.n, r["first"], r.mid) for r in ranks(df, "v").collect()}
    assert by[0] == (20, 1, 10.5) and by[1] == (20, 21, 30.5) and by[5] == (60, 101, 130.5)
    some = spark.createDataFrame([("a", float(v)) for v in (3, 1, 1, 8)] + [("b", 7.0), ("c", None)], "g string, v double")
    assert {r.g: (r.lo, r.mid) for r in quantiles(some, "g", "v", {"lo": 0.1, "mid": 0.5}).collect()} == {"a": (1.0, 2.0), "b": (7.0, 7.0)}
    got = [r.t for r in tiles(df.where("i < 23"), ["v", "i"], 5, "t").orderBy("v", "i").collect()]
    assert got == [1] * 5 + [2] * 5 + [3] * 5 + [4] * 4 + [5] * 4
    assert tiles(df.where("i < 2"), ["v", "i"], 5, "t").count() == 2 and numbered(df.where("false"), ["v"]).count() == 0


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_interval_union_and_subtract(spark):
    base = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 3, 4), ("a", 20, 20), ("b", 1, 3)], "k string, start int, end int")
    assert {tuple(r) for r in interval_union(base, "k").collect()} == {("a", 0, 9), ("b", 1, 3)}
    holes = spark.createDataFrame([("a", 4, 6), ("a", 8, 30), ("c", 0, 9)], "k string, start int, end int")
    assert {tuple(r) for r in interval_subtract(base, holes, "k").collect()} == {("a", 0, 4), ("a", 6, 8), ("b", 1, 3)}
    assert interval_union(base.where("false"), "k").count() == 0


def test_asof_both_ways_with_ties(spark):
    left = spark.createDataFrame([("m", 10, "x"), ("m", 5, "y"), ("n", 1, "z")], "k string, t int, id string")
    right = spark.createDataFrame([("m", 5, 1.0), ("m", 5, 2.0), ("m", 12, 3.0)], "k string, t int, v double")
    assert {(r.id, r.right_t, r.v) for r in asof_join(left, right, "k", "t", ["v"]).collect()} == {("x", 5, 2.0), ("y", 5, 2.0), ("z", None, None)}
    assert {(r.id, r.right_t, r.v) for r in asof_join(left, right, "k", "t", ["v"], forward=True).collect()} == {("x", 12, 3.0), ("y", 5, 2.0), ("z", None, None)}


def test_range_join_bounds(spark):
    left = spark.createDataFrame([("m", 100)], "k string, t int")
    right = spark.createDataFrame([("m", 100, 0), ("m", 99, 1), ("m", 90, 2), ("m", 89, 3), ("n", 95, 4)], "k string, t int, v int")
    assert {r.v for r in range_join(left, right, "k", "t", 10, ["v"]).collect()} == {1, 2}


def test_assoc_products_drop_zeros(spark):
    a = spark.createDataFrame([("x", "k", 2.0), ("x", "l", -1.0), ("y", "k", 3.0)], "row string, col string, val double")
    b = spark.createDataFrame([("k", "p", 1.0), ("l", "p", 2.0)], "row string, col string, val double")
    assert {tuple(r) for r in assoc.matmul(a, b).collect()} == {("y", "p", 3.0)}
    assert {tuple(r) for r in assoc.matmul(a, b, "max_plus").collect()} == {("x", "p", 3.0), ("y", "p", 4.0)}
    assert {tuple(r) for r in assoc.matmul(a, b, "or_and").collect()} == {("x", "p", 1.0), ("y", "p", 1.0)}


def test_components_and_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[41] == 40
    hops = {r.node: r.hop for r in hop_levels(edges, spark.createDataFrame([(3,)], "node long"), 2).collect()}
    assert hops[3] == 0 and hops[5] == 2 and hops[6] == -1 and hops[1] == -1


def test_products_do_not_depend_on_how_a_hot_inner_key_is_cut(spark, monkeypatch):
    entries = [(r, c, float(r * 7 % 5 + len(c))) for r in range(60) for c in ("hot", f"c{r % 4}", f"d{r}")]
    a = spark.createDataFrame(entries, "row long, col string, val double").where("val != 0")
    whole = {tuple(r) for r in assoc.matmul(a, assoc.transpose(a)).collect()}, {tuple(r) for r in assoc.co_occurrence(a, 2).collect()}
    assert len(whole[0]) > 3000 and len(whole[1]) > 300
    monkeypatch.setattr(assoc, "PART", 7)
    cut = assoc.met(a.select("row", F.col("col").alias("_k")), a.select(F.col("row").alias("_r"), F.col("col").alias("_k")), "row", "_r")
    assert ({tuple(r) for r in assoc.matmul(a, assoc.transpose(a)).collect()}, {tuple(r) for r in assoc.co_occurrence(a, 2).collect()}) == whole
    n = a.where("col = 'hot'").count()
    assert cut.where("_k = 'hot'").count() == n * n


def test_select_by_list_range_pattern_and_condition(spark):
    a = spark.createDataFrame([(f"w{i}", i, float(i % 7)) for i in range(40)] + [("x|y", 3, 1.0)], "row string, col long, val double")
    got = lambda **k: sorted(r.col for r in assoc.select(a, **k).collect())
    assert got(row=["w3", "w5", "none"]) == [3, 5] and got(col=range(2, 11, 4)) == [2, 6, 10]
    assert got(row=re.compile("w1|w2.")) == [1, *range(20, 30)] and got(row=re.compile(r"x\|y")) == [3]
    assert got(row=lambda c: c.startswith("w3"), keep=F.col("val") > 3) == [32, 33, 34, 39]
    assert got() == sorted([*range(40), 3])


@pytest.mark.parametrize("part", [2_000, 9])
def test_pairs_are_counted_where_the_lists_of_a_range_are(spark, monkeypatch, part):
    monkeypatch.setattr(assoc, "PART", part)
    monkeypatch.setattr(assoc, "PAIRS", 100)
    held = {r: {c for c in range(30) if (r * 13 + c * 7) % 11 < 4 or c == 3} for r in [*range(-5, 60), 10**12]}
    a = spark.createDataFrame([(r, c, 1.0) for r, x in held.items() for c in x] + [(None, 3, 1.0), (4, None, 1.0), (5, None, 1.0)], "row long, col long, val double")
    df = assoc.co_occurrence(a)
    assert {(x.row, x.col): x.val for x in df.collect()} == {(p, q): float(len(held[p] & held[q])) for p in held for q in held if p < q}
    # The last exchange is by range; pairs are aggregated above it without another.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(range")
    assert "Exchange" not in plan[: plan.index("Generate")]
