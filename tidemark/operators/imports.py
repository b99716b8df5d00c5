"""Stored payloads and wire frames into rows: nested JSON taken apart in the JVM, what cannot be read kept apart and named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.graph import components
from tidemark.operators.machines import STAGED_LINKS
from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.files import through

#: A wallet's address: base 58, which has no 0; every seventeenth owner's is spoilt.
_ADDRESS = "concat(CASE WHEN owner % 17 = 3 THEN '0' ELSE 'W' END, rpad(translate(CAST(owner AS STRING), '0', 'z'), 31, 'A'))"
_STORED = f"""SELECT {_ADDRESS} AS subject_id, CASE WHEN slot % 9 <> 0 THEN max(t) END AS emitted_at, max(t) + 60 + slot % 7 AS observed_at,
 to_json(struct(slot, concat('s', slot, '-', owner) AS signature, NOT (slot % 13 = 5) AS succeeded, CAST(sum(-cents * side) AS STRING) AS sol_delta_lamports, slot % 2 = 0 AS wallet_paid_fee, CAST(min(txi) AS STRING) AS fee_lamports,
  collect_list(struct(mint, CAST(delta AS STRING) AS raw_delta)) AS token_deltas)) AS payload FROM trades GROUP BY slot, owner"""
_PAYLOAD = "slot long, signature string, succeeded boolean, sol_delta_lamports string, wallet_paid_fee boolean, fee_lamports string, token_deltas array<struct<mint: long, raw_delta: string>>"


def imported(stored: DataFrame) -> DataFrame:
    """Stored wallet transactions (subject_id, emitted_at, observed_at, payload) as trades, each with its outcome.

    The store keeps block time in emitted_at and fetch time in observed_at; here they are
    block_time and seen_at. Failed ones moved nothing, several legs have no price of their
    own, a spoilt address is refused and never mended: those are counted, not split. A row
    without a block time stays: its slot still orders it.
    """
    p = stored.select("subject_id", F.col("emitted_at").alias("block_time"), F.col("observed_at").alias("seen_at"), F.from_json("payload", _PAYLOAD).alias("p"))
    legs = F.expr("filter(p.token_deltas, x -> try_cast(x.raw_delta AS DECIMAL(38, 0)) <> 0)")
    p = p.withColumn("legs", legs).withColumn("leg", F.expr("try_element_at(legs, 1)")).withColumn("delta", F.expr("try_cast(leg.raw_delta AS BIGINT)"))
    outcome = F.when(F.col("p.signature").isNull(), "malformed").when(F.coalesce(~F.col("p.succeeded"), F.lit(False)), "failed").when(F.coalesce(F.size("legs"), F.lit(0)) != 1, "legs").when(~F.col("subject_id").rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "address").otherwise("trade")
    fee = F.when(F.col("p.wallet_paid_fee"), F.coalesce(F.col("p.fee_lamports").try_cast("long"), F.lit(0))).otherwise(0)
    x = p.withColumn("outcome", outcome)
    only = lambda c: F.when(F.col("outcome") == "trade", c)
    return x.select(F.col("p.slot").alias("slot"), "subject_id", "outcome", only(F.col("leg.mint")).alias("mint"), only(F.when(F.col("delta") > 0, "buy").otherwise("sell")).alias("side"), only(F.abs("delta")).alias("tokens"), only(F.col("p.sol_delta_lamports").try_cast("long") + fee).alias("lamports"), "block_time", "seen_at")


_IMPORTED = """WITH g AS (SELECT slot, owner, max(t) AS t, CAST(sum(-cents * side) AS BIGINT) AS paid, min(txi) AS fee, list({'mint': mint, 'delta': delta}) AS legs FROM trades WHERE delta <> 0 GROUP BY slot, owner),
 o AS (SELECT *, CASE WHEN slot % 13 = 5 THEN 'failed' WHEN len(legs) <> 1 THEN 'legs' WHEN owner % 17 = 3 THEN 'address' ELSE 'trade' END AS outcome FROM g)
SELECT slot, CASE WHEN owner % 17 = 3 THEN '0' ELSE 'W' END || rpad(replace(CAST(owner AS VARCHAR), '0', 'z'), 31, 'A') AS subject_id, outcome, CASE WHEN outcome = 'trade' THEN legs[1].mint END AS mint, CASE WHEN outcome <> 'trade' THEN NULL WHEN legs[1].delta > 0 THEN 'buy' ELSE 'sell' END AS side,
 CASE WHEN outcome = 'trade' THEN abs(legs[1].delta) END AS tokens, CASE WHEN outcome = 'trade' THEN paid + CASE WHEN slot % 2 = 0 THEN fee ELSE 0 END END AS lamports, CASE WHEN slot % 9 <> 0 THEN t END AS block_time, t + 60 + slot % 7 AS seen_at FROM o"""


@query("wallet_tx_import", oracle(_IMPORTED))
def wallet_tx_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape's transactions by slot and owner, stored with their payloads and imported from there."""
    at = through(run(spark, sf_dir, _STORED), "json", "stored")
    return imported(spark.read.schema("subject_id string, emitted_at long, observed_at long, payload string").json(at))


#: Frames as they come: acknowledgements, creations and trades, kinds that nobody knows, and three ways to be no frame.
_FRAMES = """SELECT event_id AS seq, t AS t_ingest, CASE WHEN event_id % 100 = 7 THEN substr(raw, 1, 9) WHEN event_id % 100 = 8 THEN concat('[', raw, ']') WHEN event_id % 100 = 9 THEN replace(raw, concat('"', kind, '"'), '5') ELSE raw END AS raw
FROM (SELECT event_id, t, kind, CASE WHEN kind = 'signup' THEN concat('{"message": "subscribed ', user_id, '"}') ELSE concat('{"txType": "', kind, '", "mint": "m', user_id, '", "signature": "s', event_id, '", "pool": ', CASE WHEN event_id % 2 = 0 THEN '"amm"' ELSE 'null' END, CASE WHEN kind = 'purchase' THEN concat(', "timestamp": ', t) ELSE '' END, '}') END AS raw FROM ev) x"""
_KINDS = {"view": "create", "purchase": "trade"}


def classified(frames: DataFrame) -> DataFrame:
    """Frames (seq, t_ingest, raw) with class, reason of a defect, and the fields worth an index. The event's own clock is kept where it has one, and its source is said."""
    v, kind = "try_parse_json(raw)", "try_variant_get(v, '$.txType', 'variant')"
    x = frames.withColumn("v", F.expr(v)).withColumn("type", F.expr("schema_of_variant(v)")).withColumn("tx", F.expr(f"schema_of_variant({kind})")).withColumn("tx_type", F.expr("try_variant_get(v, '$.txType', 'string')"))
    field = lambda c: F.expr(f"try_variant_get(v, '$.{c}', 'string')")
    reason = F.when(F.col("v").isNull(), "not json").when(~F.col("type").startswith("OBJECT"), "not an object").when(F.col("tx").isNotNull() & ~F.col("tx").isin("STRING", "VOID"), "txType is no string")
    known = F.create_map(*(F.lit(w) for p in _KINDS.items() for w in p))
    x = x.withColumn("reason", reason)
    clock = F.expr("try_variant_get(v, '$.timestamp', 'bigint')")
    whole = F.col("reason").isNull()
    control = field("message").isNotNull() & F.col("tx_type").isNull()
    cls = F.when(~whole, "defect").when(control, "control").otherwise(F.coalesce(known[F.col("tx_type")], F.lit("unclassified")))
    only = lambda c: F.when(whole & ~control, c)
    return x.select("seq", cls.alias("class"), "reason", only(F.col("tx_type")).alias("tx_type"), only(field("mint")).alias("mint"), only(field("signature")).alias("signature"), only(field("pool")).alias("venue"), only(clock).alias("t_event"), F.when(~whole, "local").when(only(clock).isNotNull(), "vendor").otherwise("absent").alias("t_event_source"), F.length("raw").cast("long").alias("raw_length"), "t_ingest")


_CLASSIFIED = """WITH e AS (SELECT *, CASE WHEN event_id % 100 = 7 THEN 'not json' WHEN event_id % 100 = 8 THEN 'not an object' WHEN event_id % 100 = 9 AND kind <> 'signup' THEN 'txType is no string' END AS reason, kind = 'signup' AS control,
  length(CASE WHEN kind = 'signup' THEN printf('{"message": "subscribed %d"}', user_id) ELSE printf('{"txType": "%s", "mint": "m%d", "signature": "s%d", "pool": %s%s}', kind, user_id, event_id, CASE WHEN event_id % 2 = 0 THEN '"amm"' ELSE 'null' END, CASE WHEN kind = 'purchase' THEN ', "timestamp": ' || t ELSE '' END) END) AS n FROM ev),
 f AS (SELECT *, reason IS NULL AND NOT control AS plain FROM e)
SELECT event_id AS seq, CASE WHEN reason IS NOT NULL THEN 'defect' WHEN control THEN 'control' WHEN kind = 'view' THEN 'create' WHEN kind = 'purchase' THEN 'trade' ELSE 'unclassified' END AS class, reason,
 CASE WHEN plain THEN kind END AS tx_type, CASE WHEN plain THEN 'm' || user_id END AS mint, CASE WHEN plain THEN 's' || event_id END AS signature, CASE WHEN plain AND event_id % 2 = 0 THEN 'amm' END AS venue, CASE WHEN plain AND kind = 'purchase' THEN t END AS t_event,
 CASE WHEN reason IS NOT NULL THEN 'local' WHEN plain AND kind = 'purchase' THEN 'vendor' ELSE 'absent' END AS t_event_source, CAST(CASE WHEN event_id % 100 = 7 THEN 9 WHEN event_id % 100 = 8 THEN n + 2 WHEN reason IS NOT NULL THEN n - length(kind) - 1 ELSE n END AS BIGINT) AS raw_length, t AS t_ingest FROM f"""


@query("frame_classify", oracle(_CLASSIFIED))
def frame_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as wire frames, each into its class; what is no frame is a defect with its reason."""
    return classified(run(spark, sf_dir, _FRAMES))


#: A page: a brand's poll of ten days with the volumes of its mints; an entry without a volume is a defect.
_PAGES = """SELECT p_brand AS board, d div 10 AS poll, to_json(struct(max(d) AS server_ts, collect_list(struct(mint, p_name AS symbol, CASE WHEN mint % 50 <> 7 THEN v5 END AS v5)) AS entries)) AS page
FROM (SELECT p_brand, p_name, mint, d div 10 * 10 AS d, sum(qty) AS v5 FROM trades JOIN part ON p_partkey = mint GROUP BY p_brand, p_name, mint, d div 10) x GROUP BY p_brand, d div 10"""
_PAGE_ROWS = """SELECT board, poll, mint, v5, CASE WHEN v5 IS NOT NULL THEN row_number() OVER (PARTITION BY board, poll ORDER BY v5 DESC NULLS LAST, mint) END AS place, v5 IS NULL AS defect FROM (SELECT p_brand AS board, d // 10 AS poll, mint, CASE WHEN mint % 50 <> 7 THEN CAST(sum(qty) AS BIGINT) END AS v5 FROM trades JOIN part ON p_partkey = mint GROUP BY p_brand, mint, d // 10) x"""


@query("mover_page_parse", oracle(_PAGE_ROWS))
def mover_page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a board parsed to rows with their place by volume; entries without one are kept as defects."""
    pages = spark.read.schema("board string, poll long, page string").json(through(run(spark, sf_dir, _PAGES), "json", "pages"))
    rows = pages.select("board", "poll", F.explode(F.from_json("page", "server_ts long, entries array<struct<mint: long, symbol: string, v5: long>>")["entries"]).alias("e")).select("board", "poll", "e.mint", "e.v5")
    rows.createOrReplaceTempView("page_rows")
    return spark.sql("SELECT board, poll, mint, v5, CASE WHEN v5 IS NOT NULL THEN row_number() OVER (PARTITION BY board, poll ORDER BY v5 DESC NULLS LAST, mint) END AS place, v5 IS NULL AS defect FROM page_rows")


#: Candles: for a mint and year, arrays of text; a price of every hundred and first day is no number.
_CANDLES = """SELECT mint, d div 365 AS year, to_json(collect_list(array(CAST(d AS STRING), CASE WHEN d % 101 = 5 THEN 'n/a' ELSE CAST(open AS STRING) END, CAST(high AS STRING), CAST(low AS STRING), CAST(volume AS STRING)))) AS body
FROM (SELECT mint, d, min_by(cents, struct(slot, txi, owner)) AS open, max(cents) AS high, min(cents) AS low, sum(qty) AS volume FROM trades GROUP BY mint, d) x GROUP BY mint, d div 365"""
_CANDLE_ROWS = "SELECT mint, d, CASE WHEN d % 101 <> 5 THEN arg_min(cents, row(slot, txi, owner)) END AS open, max(cents) AS high, min(cents) AS low, CAST(sum(qty) AS BIGINT) AS volume, d % 101 = 5 AS defect FROM trades GROUP BY mint, d"


@query("parse_candles", oracle(_CANDLE_ROWS))
def parse_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of candles, arrays of numbers as text, parsed to rows; one with a field that is no number is kept as a defect."""
    bodies = spark.read.schema("mint long, year long, body string").json(through(run(spark, sf_dir, _CANDLES), "json", "candles"))
    c = bodies.select("mint", F.explode(F.from_json("body", "array<array<string>>")).alias("c"))
    fields = [F.expr(f"try_element_at(c, {i + 1})").try_cast("long").alias(n) for i, n in enumerate(("d", "open", "high", "low", "volume"))]
    return c.select("mint", *fields).withColumn("defect", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("volume").isNull())


#: Rows of a listing: how many, how many keys, and which of the first key's hundreds are empty.
_LISTED = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}
statement("listing_census", " UNION ALL ".join(f"SELECT '{t}' AS table_, count(*) AS n, count(DISTINCT {k}) AS keys, count(*) - count({k}) AS nulls, CAST(min({k}) AS BIGINT) AS low, CAST(max({k}) AS BIGINT) AS high, count(*) > count(DISTINCT {k}) AS repeats FROM {t}" for t, k in _LISTED.items()))

#: A crew: who launched three mints or more; its wallets are those of its mints' first slots. A mint fallen to half its high at the end has ripped.
_CREWS = """f AS (SELECT mint, min_by(owner, struct(t, slot, txi, owner)) AS crew, min_by(slot, struct(t, slot, txi, owner)) AS birth, max_by(px, struct(t, slot, txi, owner)) < 0.5 * max(px) AS ripped FROM trades GROUP BY mint),
 crews AS (SELECT crew, count(*) AS n_coins, count(*) FILTER (WHERE ripped) AS rips FROM f GROUP BY crew HAVING count(*) >= 3)"""
_CREW_JOIN = f"""WITH {_CREWS}, wallets AS (SELECT DISTINCT f.crew, l.owner FROM f JOIN crews ON crews.crew = f.crew JOIN trades l ON l.slot = f.birth AND l.mint = f.mint),
 traders AS (SELECT DISTINCT mint, owner FROM trades), o AS (SELECT t.mint, w.crew, count(*) AS n FROM traders t JOIN wallets w ON w.owner = t.owner GROUP BY t.mint, w.crew),
 best AS (SELECT mint, crew, n FROM (SELECT o.mint, o.crew, n, row_number() OVER (PARTITION BY o.mint ORDER BY n DESC, o.crew) AS rn FROM o JOIN f ON f.mint = o.mint WHERE o.crew <> f.crew) x WHERE rn = 1)
SELECT f.mint, crews.crew AS direct_crew, crews.n_coins, crews.rips, best.crew AS overlap_crew, best.n AS n_overlap FROM f LEFT JOIN crews ON crews.crew = f.crew LEFT JOIN best ON best.mint = f.mint"""
_CREW_LISTS = f"""WITH {_CREWS}, wallets AS (SELECT f.crew, list(DISTINCT l.owner) AS ws FROM f SEMI JOIN crews ON crews.crew = f.crew JOIN trades l ON l.slot = f.birth AND l.mint = f.mint GROUP BY f.crew),
 traders AS (SELECT mint, list(DISTINCT owner) AS os FROM trades GROUP BY mint), p AS (SELECT t.mint, w.crew, len(list_intersect(os, ws)) AS n FROM traders t, wallets w),
 best AS (SELECT p.mint, min(row(-n, p.crew)) AS b FROM p JOIN f ON f.mint = p.mint AND f.crew <> p.crew WHERE n > 0 GROUP BY p.mint)
SELECT f.mint, crews.crew AS direct_crew, n_coins, rips, b[2] AS overlap_crew, -b[1] AS n_overlap FROM f LEFT JOIN crews USING (crew) LEFT JOIN best USING (mint)"""
statement("dossier_crew_join", _CREW_JOIN, _CREW_LISTS)

#: What becomes of a watch that a signup opens: an error closes it, another signup replaces it; else it is open, or lost if its user fell silent for ten days.
_SILENT = 864_000
_AUDIT = f"""WITH e AS (SELECT user_id, event_id, kind, t, get_json_object(props, '$.k') IS NULL AS malformed, max(t) OVER (PARTITION BY user_id) AS last FROM ev), z AS (SELECT max(t) AS end_ FROM ev),
 w AS (SELECT user_id, kind, t, last, malformed, first_value(CASE WHEN kind IN ('signup', 'error') THEN kind END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS then_ FROM e)
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE malformed) AS malformed, count(*) FILTER (WHERE kind = 'signup') AS opened, count(*) FILTER (WHERE kind = 'signup' AND then_ = 'error') AS closed, count(*) FILTER (WHERE kind = 'signup' AND then_ = 'signup') AS replaced,
 count(*) FILTER (WHERE kind = 'signup' AND then_ IS NULL AND end_ - last <= {_SILENT}) AS open_, count(*) FILTER (WHERE kind = 'signup' AND then_ IS NULL AND end_ - last > {_SILENT}) AS lost FROM w, z GROUP BY user_id"""
_AUDIT_LOOKUP = f"""WITH s AS (SELECT a.user_id, a.event_id, (SELECT arg_min(b.kind, row(b.t, b.event_id)) FROM ev b WHERE b.user_id = a.user_id AND b.kind IN ('signup', 'error') AND (b.t > a.t OR (b.t = a.t AND b.event_id > a.event_id))) AS then_ FROM ev a WHERE a.kind = 'signup'),
 u AS (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS malformed, (SELECT max(t) FROM ev) - max(t) > {_SILENT} AS silent FROM ev GROUP BY user_id)
SELECT u.user_id, any_value(events) AS events, any_value(malformed) AS malformed, count(s.event_id) AS opened, count(*) FILTER (WHERE then_ = 'error') AS closed, count(*) FILTER (WHERE then_ = 'signup') AS replaced, count(s.event_id) FILTER (WHERE then_ IS NULL AND NOT silent) AS open_, count(s.event_id) FILTER (WHERE then_ IS NULL AND silent) AS lost FROM u LEFT JOIN s USING (user_id) GROUP BY u.user_id"""
statement("tape_audit", _AUDIT, _AUDIT_LOOKUP)

#: A catalog of facts by commit: the tape commits each day, the callers' source a week late and only from its registration on; what commit 1500 knew.
_CUT, _REGISTERED = 1500, 200
_COMMITS = f"""c AS (SELECT 'tape' AS source, mint, d AS commit, slot AS fact, txi AS version, px AS value FROM trades UNION ALL SELECT 'callers', mint, (t - 43200) div 86400 + 7, call_id, 0, price FROM calls WHERE (t - 43200) div 86400 + 7 >= {_REGISTERED})"""
_KNOWN = f"""WITH {_COMMITS} SELECT source, mint, count(*) AS facts, max(commit) AS last_commit, max_by(fact, struct(commit, fact, version, value)) AS last_fact, max_by(value, struct(commit, fact, version, value)) AS value FROM c WHERE commit <= {_CUT} GROUP BY source, mint"""
_KNOWN_RANKED = f"""WITH {_COMMITS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, mint ORDER BY commit DESC, fact DESC, version DESC, value DESC) AS rn, count(*) OVER (PARTITION BY source, mint) AS facts FROM c WHERE commit <= {_CUT}) SELECT source, mint, facts, commit AS last_commit, fact AS last_fact, value FROM r WHERE rn = 1"""
statement("as_known_catalog", _KNOWN, _KNOWN_RANKED)

_HOLDINGS = "SELECT owner, CAST(sum(qty) AS BIGINT) AS q FROM trades GROUP BY owner"
_TOP10 = f"""WITH RECURSIVE h AS ({_HOLDINGS}), l AS ({STAGED_LINKS}), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach),
 e AS (SELECT coalesce(x.entity, owner) AS entity, CAST(sum(q) AS BIGINT) AS q FROM h LEFT JOIN (SELECT node, min(reach) AS entity FROM r GROUP BY node) x ON node = owner GROUP BY 1), t AS (SELECT CAST(sum(q) AS DOUBLE) AS q FROM h)
SELECT a.q / t.q AS naive, b.q / t.q AS adjusted, b.q / t.q - a.q / t.q AS delta FROM (SELECT CAST(sum(q) AS DOUBLE) AS q FROM (SELECT q FROM h ORDER BY q DESC, owner LIMIT 10) x) a, (SELECT CAST(sum(q) AS DOUBLE) AS q FROM (SELECT q FROM e ORDER BY q DESC, entity LIMIT 10) y) b, t"""


@query("top10_delta", oracle(_TOP10))
def top10_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the ten largest holders, by wallet and by the entities that links between wallets make of them."""
    holdings = run(spark, sf_dir, _HOLDINGS)
    entities = holdings.join(components(run(spark, sf_dir, STAGED_LINKS)), F.col("owner") == F.col("node"), "left").groupBy(F.coalesce("component", "owner").alias("owner")).agg(F.sum("q").cast("long").alias("q"))
    top = lambda df, n: df.orderBy(F.desc("q"), "owner").limit(10).agg(F.sum("q").cast("double").alias(n))
    total = holdings.agg(F.sum("q").cast("double").alias("t"))
    # One row each.
    one = top(holdings, "a").join(F.broadcast(top(entities, "b"))).join(F.broadcast(total))
    return one.select((F.col("a") / F.col("t")).alias("naive"), (F.col("b") / F.col("t")).alias("adjusted"), (F.col("b") / F.col("t") - F.col("a") / F.col("t")).alias("delta"))
