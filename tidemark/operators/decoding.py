"""Decoding of text and bytes, one row at a time inside Arrow batches; the oracles are the values that were encoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.operators.sql import run, statement
from tidemark.plans.tape import oracle
from tidemark.sources.code import ship

#: The digits of base 58.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_bytes(text: str | None, size: int | None = None) -> bytes | None:
    """The bytes that text stands for (leading 1s: zero bytes); None if text is null or empty, holds another sign, or has not `size` bytes."""
    if not text or any(c not in BASE58 for c in text):
        return None
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    out = bytes(len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return out if size is None or len(out) == size else None


def base58_text(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


@query("base58_decode", oracle("SELECT owner, mint, true AS valid FROM (SELECT DISTINCT owner, mint FROM trades) x UNION ALL SELECT owner, CAST(NULL AS BIGINT), false FROM (SELECT DISTINCT owner FROM trades) x"))
def base58_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 32 bytes that hold a mint in their last 8; each owner also has one with a sign outside the alphabet."""
    ship(spark)

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = [base58_text(bytes(16) + b"key-of-a-mint"[:8] + int(m).to_bytes(8, "big")) if m == m else "0OIl" for m in x["mint"].astype("float64")]
            got = [base58_bytes(t, 32) for t in texts]
            yield pd.DataFrame({"owner": x["owner"], "mint": pd.array([None if g is None else int.from_bytes(g[-8:], "big") for g in got], dtype="Int64"), "valid": [g is not None for g in got]})

    rows = run(spark, sf_dir, "SELECT DISTINCT owner, mint FROM trades UNION ALL SELECT owner, CAST(NULL AS BIGINT) FROM (SELECT DISTINCT owner FROM trades) x")
    return rows.mapInPandas(both, "owner long, mint long, valid boolean")


#: The layout of a trade event after its 8 bytes of discriminator; integers are little-endian.
TRADE_EVENT = struct.Struct("<8sqqqqB")
DISCRIMINATOR = b"tapetrad"


def borsh_event(data: bytes | None) -> tuple | None:
    """mint, owner, units, cents and side of a trade event; None if the bytes are no whole trade event."""
    if data is None or len(data) != TRADE_EVENT.size:
        return None
    head, mint, owner, qty, cents, buy = TRADE_EVENT.unpack(data)
    return (mint, owner, qty, cents, buy == 1) if head == DISCRIMINATOR and buy < 2 else None


@query("borsh_decode", oracle("SELECT slot, txi, mint, owner, qty, cents, side = 1 AS is_buy FROM trades WHERE txi <> 7 UNION ALL SELECT slot, txi, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM trades WHERE txi = 7"))
def borsh_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from bytes that expressions put together; those of the seventh line are cut short and give nulls."""
    ship(spark)
    little = lambda c: "concat(" + ", ".join(f"substr(unhex(lpad(hex(CAST({c} AS BIGINT)), 16, '0')), {i}, 1)" for i in range(8, 0, -1)) + ")"
    data = f"concat(encode('{DISCRIMINATOR.decode()}', 'UTF-8'), {little('mint')}, {little('owner')}, {little('qty')}, {little('cents')}, unhex(CASE WHEN side = 1 THEN '01' ELSE '00' END))"
    rows = run(spark, sf_dir, f"SELECT slot, CAST(txi AS INT) AS txi, CASE WHEN txi = 7 THEN substr({data}, 1, 20) ELSE {data} END AS data FROM trades")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [borsh_event(b) or (None,) * 5 for b in x["data"]]
            columns = list(zip(*got, strict=True)) if got else [()] * 5
            yield pd.DataFrame({"slot": x["slot"], "txi": x["txi"], **{n: pd.array(c, dtype="boolean" if n == "is_buy" else "Int64") for n, c in zip(("mint", "owner", "qty", "cents", "is_buy"), columns, strict=True)}})

    return rows.mapInPandas(decode, "slot long, txi int, mint long, owner long, qty long, cents long, is_buy boolean")


# Keys in order, no white space, UTF-8; the digest names its function.
statement(
    "canonical_json_digest",
    "SELECT c_custkey, concat('sha256:', sha2(to_json(named_struct('key', c_custkey, 'name', c_name, 'nation', c_nationkey)), 256)) AS digest FROM customer",
    """SELECT c_custkey, 'sha256:' || sha256('{"key":' || c_custkey || ',"name":' || to_json(c_name) || ',"nation":' || c_nationkey || '}') AS digest FROM customer""",
)


@query("sqlite_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of SQLite catalogs: every catalog is one file's bytes, opened read-only in a task. Here each region's nations make one."""
    ship(spark)

    def catalog(x: pd.DataFrame) -> pd.DataFrame:
        import sqlite3

        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", x[["n_nationkey", "n_name", "n_regionkey"]].astype(object).values.tolist())
        db.commit()
        return pd.DataFrame({"content": [db.serialize()]})

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))
    return sqlite_rows(nations.groupBy("n_regionkey").applyInPandas(catalog, "content binary"), "SELECT n_nationkey, n_name, n_regionkey FROM nation", "n_nationkey long, n_name string, n_regionkey long").select(*(F.col(c).cast(t) for c, t in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").dtypes))


def sqlite_rows(catalogs: DataFrame, text: str, schema: str) -> DataFrame:
    """What the statement gives on each catalog of a column `content`, such as spark.read.format("binaryFile") has; a task streams one catalog at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                db.execute("PRAGMA query_only = 1")
                cursor = db.execute(text)
                names = [c[0] for c in cursor.description]
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)

    return catalogs.select("content").mapInPandas(read, schema)
