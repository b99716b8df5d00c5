"""Counting fingerprints of text windows over a whole corpus, block by block.

Documents are packed into blocks of a few MB, kept in a table that is bucketed by
block. A round then works like this:

1. every block emits, for each fingerprint bucket, the sorted distinct fingerprints
   of its windows with their local counts, as one delta-coded binary row;
2. a bucket's task merges the rows of all blocks, sorts them once and answers each
   block with one bit (or count) for each fingerprint that it sent, in the order sent;
3. the answers are joined to the blocks, which were never shuffled, and each block
   works out its own fingerprints again to read the answers.

A block sends a fingerprint once however often it holds it, so the copies of a hot
passage are merged before the shuffle, and no task ever holds the rows of a key.
A bucket takes about BUCKET_ROWS fingerprints: the number of buckets follows the
corpus. Fingerprints have 64 bits, and the bucket adds independent ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import hashing as H
from tidemark.llm.storage import give_back, map_arrow, partitions, scratch_table

BLOCK_BYTES = 4 << 20
BUCKET_ROWS = 4_000_000
#: Bytes that are hashed together inside a block; bounds the working arrays.
CHUNK_BYTES = 1 << 18

BLOCK_SCHEMA = "block long, n_rows int, n_bytes long, n_words long, payload binary"
SENT_SCHEMA = "bucket int, block long, n int, data binary"
REPLY_SCHEMA = "block long, bucket int, data binary"
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


@dataclass
class Blocks:
    """A corpus in blocks: the table, the schema of its documents, and its size."""

    table: DataFrame
    schema: T.StructType
    text: str
    n_rows: int
    n_bytes: int
    n_words: int

    def buckets(self, n: int) -> int:
        """Buckets for n fingerprints."""
        return max(partitions(self.table.sparkSession), math.ceil(n / BUCKET_ROWS))


def to_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Pack documents into blocks (a longer document is a block of its own) in a table bucketed by block."""
    spark = docs.sparkSession
    name = scratch_table(spark, "blocks")
    at = docs.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in H.chunks(offsets, block_bytes):
                piece = batch.slice(lo, hi - lo)
                data, off = texts(piece.column(at))
                start, _, _ = H.words(data, off)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(piece)
                yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) | n], pa.int64()), "n_rows": pa.array([hi - lo], pa.int32()), "n_bytes": pa.array([len(data)], pa.int64()), "n_words": pa.array([len(start)], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                n += 1

    packed = map_arrow(docs, pack, BLOCK_SCHEMA)
    packed.write.bucketBy(partitions(spark), "block").saveAsTable(name, format="parquet")
    table = spark.table(name)
    size = table.agg(F.sum("n_rows"), F.sum("n_bytes"), F.sum("n_words")).first()
    return Blocks(table, docs.schema, text, size[0] or 0, size[1] or 0, size[2] or 0)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one, so that a worker holds one block's copies at a time; memory that a block took goes back after it."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            give_back()


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as r:
        return r.read_next_batch()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) in one array, and each text's offset in it (one longer)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def delta_pack(x: np.ndarray, width: int = 8) -> bytes:
    """Sorted uint64 values as byte planes of their differences; the high planes are zeros, which the shuffle's codec removes."""
    d = np.diff(x, prepend=np.uint64(0))
    return d.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def delta_unpack(data: bytes, n: int, width: int = 8) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def count_pack(x: np.ndarray) -> bytes:
    """Positive counts as byte planes, without the planes that are all zero."""
    x = x.astype(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def count_unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : data[0]] = np.frombuffer(data, np.uint8, n * data[0], 1).reshape(data[0], n).T
    return planes.view(np.uint64).ravel().astype(np.int64)


class Order:
    """A block's fingerprints by bucket and value: distinct ones, and where each of its windows is among them."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, buckets: int, bits: int = 64):
        if bits < 64:
            h1 = h1 >> np.uint64(64 - bits)
        bucket = h2 >> np.uint64(32)
        bucket *= np.uint64(buckets)
        bucket >>= np.uint64(32)
        bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(h1)
        order = order[np.argsort(bucket[order], kind="stable")]
        h, b = h1[order], bucket[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        self.rank = np.empty(len(h), np.int32)
        self.rank[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        self.values = h[new]
        self.starts = np.searchsorted(b[new], np.arange(buckets + 1))
        del h, b
        self.counts = np.diff(np.flatnonzero(new), append=len(new)).astype(np.int32)

    def rows(self, block: int, width: int = 8) -> pa.RecordBatch:
        buckets = np.flatnonzero(np.diff(self.starts)).tolist()
        out: dict[str, list] = {"bucket": buckets, "block": [block] * len(buckets), "n": [], "data": []}
        for b in buckets:
            lo, hi = self.starts[b], self.starts[b + 1]
            out["n"].append(hi - lo)
            out["data"].append(delta_pack(self.values[lo:hi], width) + count_pack(self.counts[lo:hi]))
        return pa.RecordBatch.from_pydict(out, schema=_SENT)

    def answers(self, replies: list[dict] | None, many: bool) -> np.ndarray:
        """For each distinct fingerprint, the corpus' answer: a flag, or (many) a count of at least 1."""
        out = np.ones(len(self.values), np.int64) if many else np.zeros(len(self.values), bool)
        for r in replies or ():
            lo, hi = self.starts[r["bucket"]], self.starts[r["bucket"] + 1]
            out[lo:hi] = count_unpack(r["data"], hi - lo) if many else np.unpackbits(np.frombuffer(r["data"], np.uint8), count=hi - lo).astype(bool)
        return out


def send(blocks: DataFrame, emit: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of SENT_SCHEMA from each row of blocks; emit gets the row as a dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            yield from emit(row)

    return map_arrow(blocks, run, SENT_SCHEMA)


def reply(sent: DataFrame, buckets: int, many: bool = False, width: int = 8) -> DataFrame:
    """One row for each block that has replies: block, replies (bucket and data of each bucket with a fingerprint that occurs twice or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            for bucket, block, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "data")), strict=True):
                have.setdefault(bucket, []).append((block, n, data))
        for bucket in list(have):
            rows = have.pop(bucket)
            blocks = [b for b, _, _ in rows]
            ends = np.cumsum([n for _, n, _ in rows])
            values = np.empty(ends[-1], np.uint64)
            counts = np.empty(ends[-1], np.int32)
            for i, (hi, (_, n, d)) in enumerate(zip(ends.tolist(), rows, strict=True)):
                values[hi - n : hi] = delta_unpack(d, n, width)
                counts[hi - n : hi] = count_unpack(d[n * width :], n)
                rows[i] = None
            del rows, d
            order = np.argsort(values)
            values = values[order]
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            del values
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts[order], first, dtype=np.int64)
            del counts
            if not many:
                total = np.minimum(total, 2).astype(np.uint8)
            each = np.empty(len(new), total.dtype)
            each[order] = np.repeat(total, np.diff(first, append=len(new)))
            del order, new, first, total
            out: dict[str, list] = {"block": [], "bucket": [], "data": []}
            for block, lo, hi in zip(blocks, [0, *ends[:-1]], ends, strict=True):
                got = each[lo:hi]
                if (got > 1).any():
                    out["block"].append(block)
                    out["bucket"].append(bucket)
                    out["data"].append(count_pack(got) if many else np.packbits(got > 1).tobytes())
            del each, got
            give_back()
            yield pa.RecordBatch.from_pydict(out, schema=_REPLY)

    answered = map_arrow(sent.repartitionById(buckets, "bucket"), run, REPLY_SCHEMA)
    return answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("replies"))


def with_replies(blocks: DataFrame, replies: DataFrame, name: str = "replies") -> DataFrame:
    """The blocks with their replies; the blocks' side of the join is bucketed, so only replies are shuffled."""
    return blocks.join(replies.withColumnRenamed("replies", name), "block", "left")


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a block's texts of at most CHUNK_BYTES: first, last + 1, their bytes and offsets."""
    data, offsets = texts(batch.column(at))
    for lo, hi in H.chunks(offsets, CHUNK_BYTES):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n positions lie in start..start+k-1 of any start."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + k, -1)
    return np.cumsum(mark[:-1]) > 0
