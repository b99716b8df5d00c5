"""Near duplicates: weighted minhash over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A document's terms are its shingles of five words; a term's weight is its count times
a damped inverse document frequency, 1 + ln(N / df) / (4 ln N), with document
frequencies of all terms over the whole corpus. The damping keeps a large group of
near copies, whose shared shingles are frequent, as similar as its texts are.

A text shares with another at most its terms that other documents have too. Where these
weigh less than the threshold's part of the text, no other text is similar enough, and
the text gets no samples: what is linked stays the same.

Documents with the same weighted terms are one text from the start. In every band, the
texts of a key are compared with one of them, the key's leader, and those found similar
are joined. Keys whose other texts are still of several classes are then compared
whole: their texts are dealt into cells of bounded size (cells.py), a cell compares all
its pairs by matrix products and returns only links that join classes. So no candidate
pair of different classes stays unverified, and no table ever holds a key's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import hashing as H
from tidemark.llm.blocks import Blocks, Order, delta_pack, delta_unpack, each_row, pieces, reply, send, to_blocks, unpack, with_replies
from tidemark.llm.cells import Cell
from tidemark.llm.components import components
from tidemark.llm.storage import map_arrow, written
from tidemark.llm.weighted_minhash import BANDS, band_keys, can_link, similarity

SHINGLE = 5
THRESHOLD = 0.8
DAMPING = 0.25
#: Frequencies are counted by 40 bits of a term; a few collisions change a few frequencies a little.
TERM_BITS = 40
#: A block's terms and their samples take some 60 times its bytes.
BLOCK_BYTES = 4 << 20
#: Texts, and terms of texts, that a cell's side holds about.
CELL_TEXTS = 1024
CELL_TERMS = 2_000_000

_SIGNED = pa.schema([("uid", pa.int64()), ("same1", pa.int64()), ("same2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_VECTOR = pa.schema([("uid", pa.int64()), ("n", pa.int32()), ("total", pa.float64()), ("vector", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _terms(batch: pa.RecordBatch, at: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each document's distinct shingles, by row and hash. A text of fewer than k words is one shingle."""
    rows, hashes, counts, base = [], [], [], 0
    for lo, hi, data, offsets in pieces(batch, at):
        begin, end, fw = H.words(data, offsets)
        values = H.word_hashes(data, begin, end)
        n = np.diff(fw)
        w = H.windows(values, fw, k)
        h = H.rolling(values, w, k)
        row = np.searchsorted(fw, w, side="right") - 1
        short = np.flatnonzero((n > 0) & (n < k))
        sums = H.prefix(values, H.WORD_BASE)
        h = np.concatenate([h, H.mix(H.slices(sums, H.WORD_BASE, fw[short], fw[short + 1]) + n[short].astype(np.uint64))])
        row = np.concatenate([row, short])
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        rows.append(row[first] + lo)
        hashes.append(h[first])
        counts.append(np.diff(first, append=len(h)))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(counts), np.array([base])


def _order(hashes: np.ndarray, buckets: int) -> Order:
    return Order(hashes, H.mix(hashes ^ np.uint64(H.SECOND_BASE)), buckets, TERM_BITS)


def uid(block: int, row: np.ndarray | int):
    """Number of a block's row: the task in the top bits, then the block in it, then the row."""
    return ((block >> 32) << 40 | (block & 0xFFFFF) << 20) + row


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """docs with class_uid (long, the same for the documents of one class) and keeps (boolean, true for one document of each class).

    Words are maximal runs of bytes other than ASCII white space. Classes are the
    connected components of the links of `threshold` or more. Texts without words (null,
    empty, white space) are classes of their own; repeated rows are one class. Columns
    of docs named class_uid or keeps are replaced; no row is added or dropped, and an
    empty table gives an empty one. Terms are 40-bit hashes and are not compared as text.
    """
    docs = docs.drop("class_uid", "keeps")
    b = to_blocks(docs, text, BLOCK_BYTES)
    at = docs.columns.index(text)
    buckets = b.buckets(b.n_words)
    table = b.table.select("block", "payload")

    def emit(row: dict) -> Iterator[pa.RecordBatch]:
        _, hashes, _, _ = _terms(unpack(row["payload"]), at, k)
        yield _order(hashes, buckets).rows(row["block"], TERM_BITS // 8)

    frequencies = written(reply(send(table, emit), buckets, many=True, width=TERM_BITS // 8), "frequencies")
    table = with_replies(table, frequencies)
    weigh = _weigher(b, at, k, buckets)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            rows, hashes, weights, shared, n = weigh(row)
            every = uid(row["block"], np.arange(n))
            same1, same2 = H.mix(every.astype(np.uint64)).view(np.int64), every.copy()
            bands: list = [None] * n
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
            if len(starts):
                w = weights.view(np.uint64)
                has = rows[starts]
                same1[has] = np.add.reduceat(H.mix(hashes ^ H.mix(w)), starts).view(np.int64)
                same2[has] = np.add.reduceat(H.mix(H.mix(hashes + np.uint64(H.SECOND_BASE)) + w), starts).view(np.int64)
                # Texts that cannot reach the threshold with any other need no bands.
                able = can_link(weights, shared, starts, threshold)
                size = np.diff(starts, append=len(rows))
                kept, size = np.repeat(able, size), size[able]
                if len(size):
                    for i, x in zip(has[able], band_keys(hashes[kept], weights[kept], np.cumsum(size) - size).view(np.int64).tolist(), strict=True):
                        bands[i] = x
            yield pa.RecordBatch.from_pydict({"uid": every, "same1": same1, "same2": same2, "bands": bands}, schema=_SIGNED)

    signed = written(map_arrow(table, sign, "uid long, same1 long, same2 long, bands array<long>"), "signed")
    # One text of each set of equal ones stands for all.
    first = signed.groupBy("same1", "same2").agg(F.min("uid").alias("uid"))
    texts = signed.join(first.select("uid"), "uid", "left_semi")
    members = texts.select("uid", F.explode("bands").alias("key"))
    keys = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(keys.select("key"), "key", "left_semi"), "members")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(1)
        for row in each_row(batches):
            rows, hashes, weights, shared, n = weigh(row)
            bounds = np.searchsorted(rows, np.arange(n + 1))
            out: dict[str, list] = {"uid": [], "n": [], "total": [], "vector": []}
            for u in row["wanted"]:
                i = u & 0xFFFFF
                lo, hi = bounds[i], bounds[i + 1]
                w, common = weights[lo:hi].astype("<f4"), shared[lo:hi]
                out["uid"].append(u)
                out["n"].append(int(common.sum()))
                out["total"].append(float(w.sum(dtype=np.float64)))
                out["vector"].append(codec.compress(delta_pack(hashes[lo:hi][common] >> np.uint64(24), 5) + w[common].tobytes()))
            yield pa.RecordBatch.from_pydict(out, schema=_VECTOR)

    block = (F.shiftright("uid", 40) * (1 << 32) + F.shiftright("uid", 20).bitwiseAND(0xFFFFF)).alias("block")
    # A vector holds the terms that other documents have too, and the total weight of all.
    wanted = members.select("uid").distinct().groupBy(block).agg(F.collect_list("uid").alias("wanted"))
    vector = written(map_arrow(table.join(wanted, "block"), vectors, "uid long, n int, total double, vector binary"), "vectors")
    roots = _classes(members, vector, threshold)
    text_class = first.join(roots, first["uid"] == roots["node"], "left").select("same1", "same2", F.coalesce("root", "uid").alias("class_uid"))
    # A block's copies of a text are one row before they meet its class, so a text of very many copies has as many rows as blocks.
    copies = signed.groupBy(block, "same1", "same2").agg(F.collect_list(F.col("uid").bitwiseAND(0xFFFFF).cast("int")).alias("at"))
    labels = copies.join(text_class, ["same1", "same2"]).groupBy("block").agg(F.collect_list(F.struct("at", "class_uid")).alias("labels"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            batch = unpack(row["payload"])
            label = np.zeros(batch.num_rows, np.int64)
            for x in row["labels"]:
                label[x["at"]] = x["class_uid"]
            keeps = label == uid(row["block"], np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(keeps)], names=[*batch.schema.names, "class_uid", "keeps"])

    schema = T.StructType(docs.schema.fields + [T.StructField("class_uid", T.LongType()), T.StructField("keeps", T.BooleanType())])
    return map_arrow(b.table.select("block", "payload").join(labels, "block"), finish, schema)


def _weigher(b: Blocks, at: int, k: int, buckets: int):
    scale = DAMPING / np.log(max(b.n_rows, 2))
    n_docs = max(b.n_rows, 1)

    def weigh(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        batch = unpack(row["payload"])
        rows, hashes, counts, _ = _terms(batch, at, k)
        order = _order(hashes, buckets)
        df = np.maximum(order.answers(row["replies"], True), order.counts)[order.rank]
        return rows, hashes, counts * (1 + scale * np.log(n_docs / np.minimum(df, n_docs))), df > 1, batch.num_rows

    return weigh


def _decoded(codec: zstandard.ZstdDecompressor, n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = codec.decompress(data)
    return delta_unpack(raw, n, 5), np.frombuffer(raw, "<f4", n, 5 * n).astype(np.float64)


def _classes(members: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """node, root of every text that is linked to another."""
    leader = members.groupBy("key").agg(F.min_by("uid", F.xxhash64("key", "uid")).alias("leader"))
    rest = written(members.join(leader, "key").where("uid != leader"), "led")
    pairs = rest.select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()
    links = written(_verified(pairs, vector, threshold), "links")
    roots = written(components(links), "roots")
    more = written(_compared(rest, roots, vector, threshold), "links")
    return roots if more.isEmpty() else written(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")


def _verified(pairs: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left, right = (vector.select(F.col("uid").alias(x), *(F.col(c).alias(c[0] + x) for c in ("n", "total", "vector"))) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            sides = (zip(*(batch.column(c + x).to_pylist() for c in "ntv"), strict=True) for x in "ab")
            found = [similarity((*_decoded(codec, n, v), t), (*_decoded(codec, m, u), s)) >= threshold - 1e-9 for (n, t, v), (m, s, u) in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=_LINK).filter(pa.array(found, pa.bool_()))

    return map_arrow(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def _compared(rest: DataFrame, roots: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of a key's texts, from all pairs of texts of each key that still holds several classes."""
    texts = written(rest.join(roots, F.col("uid") == F.col("node"), "left").select("key", "uid", F.coalesce("root", "uid").alias("root")).join(vector.select("uid", "n"), "uid"), "texts")
    sets = texts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("texts"), F.sum("n").alias("terms"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y")).where("lo < hi")
    # Keys of the same texts are one; a key of many texts is a triangle of cells.
    sides = F.ceil(F.greatest(F.col("texts") / CELL_TEXTS, F.col("terms") / CELL_TERMS)).alias("sides")
    keys = sets.groupBy("x", "y", "texts", "terms").agg(F.min("key").alias("key")).select("key", sides)
    block = F.pmod(F.xxhash64("uid", F.lit(2)), "sides")
    dealt = texts.join(keys, "key").select("key", "uid", "root", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "root").join(vector, "uid")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cell, at = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for key, i, j, block, uid, root, n, total, data in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "uid", "root", "n", "total", "vector")), strict=True):
                if at != (key, i, j):
                    if cell is not None:
                        yield pa.RecordBatch.from_pydict(cell.links(threshold - 1e-9), schema=_LINK)
                    cell, at = Cell(), (key, i, j)
                cell.add(uid, root, block == i, block == j, *_decoded(codec, n, data), total)
        if cell is not None:
            yield pa.RecordBatch.from_pydict(cell.links(threshold - 1e-9), schema=_LINK)

    return map_arrow(dealt, run, "a long, b long")
