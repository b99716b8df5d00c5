"""Stored payloads and frames by hand: what is kept, what is refused, and why."""

import json

import duckdb

from tidemark.operators import registry
from tidemark.operators.imports import classified, imported

GOOD = "W" + "A" * 31


def payload(**more):
    return json.dumps({"slot": 9, "signature": "s", "succeeded": True, "sol_delta_lamports": "-500", "wallet_paid_fee": True, "fee_lamports": "7", "token_deltas": [{"mint": 4, "raw_delta": "30"}]} | more)


def test_stored_transactions_keep_their_two_clocks_and_name_refusals(spark):
    rows = {
        "a": (GOOD, 100, 160, payload()),
        "b": (GOOD, None, 160, payload(token_deltas=[{"mint": 4, "raw_delta": "-3"}, {"mint": 5, "raw_delta": "0"}], wallet_paid_fee=False)),
        "c": (GOOD, 100, 160, payload(succeeded=False)),
        "d": (GOOD, 100, 160, payload(token_deltas=[{"mint": 4, "raw_delta": "1"}, {"mint": 5, "raw_delta": "2"}])),
        "e": (GOOD.replace("W", "0"), 100, 160, payload()),
        "f": (GOOD[:20], 100, 160, payload()),
        "g": (GOOD, 100, 160, "{torn"),
        "h": (GOOD, 100, 160, None),
        "i": (GOOD, 100, 160, payload(token_deltas=[{"mint": 4, "raw_delta": "x"}])),
        "j": (GOOD, 100, 160, payload(fee_lamports=None, token_deltas=None)),
    }
    got = imported(spark.createDataFrame(list(rows.values()), "subject_id string, emitted_at long, observed_at long, payload string").coalesce(1)).collect()
    assert [r.outcome for r in got] == ["trade", "trade", "failed", "legs", "address", "address", "malformed", "malformed", "legs", "legs"]
    a, b = got[:2]
    assert (a.block_time, a.seen_at, a.side, a.tokens, a.lamports, a.mint) == (100, 160, "buy", 30, -493, 4)
    assert (b.block_time, b.seen_at, b.side, b.tokens, b.lamports) == (None, 160, "sell", 3, -500)
    assert all(r.mint is None and r.lamports is None for r in got[2:])


def test_frames_by_hand(spark):
    frames = ['{"txType": "view", "mint": "m", "pool": 5}', '{"message": "hello"}', '{"message": "x", "txType": "other"}', "{}", "[1]", '"text"', "", None, '{"txType": 7}', '{"txType": null, "message": "m"}', '{"txType": "purchase", "timestamp": 12, "signature": "s"}', "{'a': 1"]
    got = {r.seq: r for r in classified(spark.createDataFrame([(i, 50, f) for i, f in enumerate(frames)], "seq long, t_ingest long, raw string")).collect()}
    assert [got[i]["class"] for i in range(len(frames))] == ["create", "control", "unclassified", "unclassified", "defect", "defect", "defect", "defect", "defect", "control", "trade", "defect"]
    assert [got[i].reason for i in (4, 5, 6, 7, 8, 11)] == ["not an object", "not an object", "not json", "not json", "txType is no string", "not json"]
    assert (got[10].t_event, got[10].t_event_source, got[10].signature) == (12, "vendor", "s") and got[0].t_event_source == "absent" and got[4].t_event_source == "local"
    assert classified(spark.createDataFrame([], "seq long, t_ingest long, raw string")).count() == 0


def test_whole_inputs_have_rows_on_both_sides_of_every_cut(spark):
    """Parameters that leave a result empty, or all of its input, would compare nothing."""
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    rows = {n: con.execute(f"SELECT count(*) FROM ({registry.oracle_sql()[n]}) x").fetchone()[0] for n in ("assoc_restrict_degree", "hub_exclusion", "not_in_subquery", "filter_conjunction")}
    assert 0 < rows["filter_conjunction"] < 2000 and 0 < rows["not_in_subquery"] < 100 and 0 < rows["hub_exclusion"] < 1500 and 0 < rows["assoc_restrict_degree"] < 55_000, rows
