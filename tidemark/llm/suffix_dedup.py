"""Suffix dedup: bytes covered by a string of 200 bytes that starts anywhere else too are removed.

Difference-cover blockwise construction. The cover D of period 133 has, for any two
positions, a shift under 133 that takes both into the sample (positions, counted from
their document's start, whose residue is in D). So a 200-byte string that occurs twice
holds a sample suffix whose first 68 bytes occur at another sample position.

1. Every sample suffix is named by its first 68 bytes, and names are counted in the
   corpus: the sample's ranks, as far as equality at that depth goes.
2. A suffix is looked at further only if the sample within its first 133 positions holds
   a repeated name. Such suffixes go to buckets by a fingerprint of their 200 bytes; one
   bucket is sorted at a time, and its ties are the repeated strings.

Ties are settled by fingerprints of 64 bits and the bucket's independent ones rather
than by reading on in the text: sorting buckets by the text itself would ship 200 bytes
for every suffix. Memory is bounded by the block and the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import hashing as H
from tidemark.llm.blocks import Order, covered, each_row, pieces, reply, send, to_blocks, unpack, with_replies
from tidemark.llm.storage import map_arrow, written

LENGTH = 200
PERIOD = 133
#: A perfect difference set, every residue of 133 is a difference of two of these.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: A sample's name needs no more bits than keep false alarms rare; step 2 settles them.
NAME_BITS = 40
BLOCK_BYTES = 4 << 20


def _samples(batch: pa.RecordBatch, at: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and positions (in the block's bytes) of all sample suffixes of at least `depth` bytes."""
    h1, h2, where, base = [], [], [], 0
    for _, _, data, offsets in pieces(batch, at):
        p = _cover(offsets, depth)
        h1.append(H.rolling(data, p, depth, H.BYTE_BASE))
        h2.append(H.mix(h1[-1] ^ np.uint64(H.SECOND_BASE)))
        where.append(p + base)
        base += len(data)
    return np.concatenate(h1), np.concatenate(h2), np.concatenate(where)


def _cover(offsets: np.ndarray, depth: int) -> np.ndarray:
    """The positions of all texts whose distance from their text's start is in the cover, and which have `depth` bytes left."""
    n = np.maximum(np.diff(offsets) - depth + 1, 0)  # positions of each text that have them
    full, rest = n // PERIOD, n % PERIOD
    many = full * len(COVER) + np.searchsorted(COVER, rest)
    first = np.repeat(offsets[:-1], many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first + place // len(COVER) * PERIOD + np.array(COVER)[place % len(COVER)]


def _suffixes(batch: pa.RecordBatch, at: int, length: int, repeated: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both fingerprints and the positions of the suffixes that hold a repeated sample within their first PERIOD positions."""
    mark = np.zeros(n + PERIOD + 1, np.int32)
    mark[repeated + 1] = 1
    total = np.cumsum(mark)
    h1, h2, where, base = [], [], [], 0
    for _, _, data, offsets in pieces(batch, at):
        w = H.windows(data, offsets, length)
        w = w[total[np.minimum(base + w + PERIOD, n)] > total[base + w]]
        h1.append(H.rolling(data, w, length, H.BYTE_BASE))
        h2.append(H.rolling(data, w, length, H.SECOND_BASE))
        where.append(w + base)
        base += len(data)
    return np.concatenate(h1), np.concatenate(h2), np.concatenate(where)


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without `text`, with n_bytes, n_removed (long), spans (array of start, end: the maximal removed runs) and kept (binary: the other bytes).

    A text is its UTF-8 bytes (null: none); matches never cross documents. A byte goes if
    a string of `length` bytes that covers it also starts anywhere else, its own document
    included. Strings are judged on the input. Texts shorter than that lose nothing;
    repeated rows are separate documents, so both go; an empty table gives an empty one.
    Columns of docs with the new names are replaced.
    """
    depth = length - PERIOD + 1
    if depth < 1:
        raise ValueError(f"length must be {PERIOD} or more")
    new = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    docs = docs.drop(*new.fieldNames())
    b = to_blocks(docs, text, BLOCK_BYTES)
    at = docs.columns.index(text)
    name_buckets, buckets = b.buckets(b.n_bytes // 10), b.buckets(b.n_bytes // 2)
    width = NAME_BITS // 8

    def emit_names(row: dict) -> Iterator[pa.RecordBatch]:
        h1, h2, _ = _samples(unpack(row["payload"]), at, depth)
        yield Order(h1, h2, name_buckets, NAME_BITS).rows(row["block"], width)

    def candidates(row: dict, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        n = sum(len(t) for _, _, t, _ in pieces(batch, at))
        h1, h2, where = _samples(batch, at, depth)
        order = Order(h1, h2, name_buckets, NAME_BITS)
        repeated = (order.answers(row["names"], False) | (order.counts > 1))[order.rank]
        return *_suffixes(batch, at, length, where[repeated], n), n

    def emit_suffixes(row: dict) -> Iterator[pa.RecordBatch]:
        h1, h2, _, _ = candidates(row, unpack(row["payload"]))
        yield Order(h1, h2, buckets).rows(row["block"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            batch = unpack(row["payload"])
            h1, h2, where, n = candidates(row, batch)
            order = Order(h1, h2, buckets)
            repeated = (order.answers(row["replies"], False) | (order.counts > 1))[order.rank]
            yield from _outputs(batch, at, covered(where[repeated], length, n))

    table = b.table.select("block", "payload")
    names = written(reply(send(table, emit_names), name_buckets, width=width), "names")
    table = with_replies(table, names, "names")
    schema = T.StructType([f for f in docs.schema if f.name != text] + new.fields)
    return map_arrow(with_replies(table, reply(send(table, emit_suffixes), buckets)), finish, schema)


def _outputs(batch: pa.RecordBatch, at: int, gone: np.ndarray, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    done = 0
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        sizes, removed, spans, kept = [], [], [], []
        for t in part.column(at).to_pylist():
            raw = np.frombuffer((t or "").encode(), np.uint8)
            out = gone[done : done + len(raw)]
            done += len(raw)
            edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
            sizes.append(len(raw))
            removed.append(int(out.sum()))
            spans.append([{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(raw[~out].tobytes())
        yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at] + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[n for i, n in enumerate(part.schema.names) if i != at] + ["n_bytes", "n_removed", "spans", "kept"])
