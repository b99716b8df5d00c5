"""Token ids in patched frame-of-reference segments.

A segment holds the ids of consecutive documents in one byte string:

    magic "PFR1", then little-endian uint32: number of ids, block size, number of blocks
    uint32[blocks + 1]   byte offset of each block's packed values (the block index)
    uint32[blocks]       minimum of each block
    uint8[blocks]        width of each block in bits
    uint32[blocks + 1]   number of exceptions before each block
    packed values        id - minimum, its low `width` bits, least significant bit first
    uint16[exceptions]   place of each exception in its block
    uint32[exceptions]   id - minimum of each exception

A block's width is the one that holds a given percentile of its values; larger values
are exceptions. Any block can be read alone. Segments are rows of a Parquet table, in
order of task and number, so that Spark's commit protocol and any file system that
Spark reaches serve for writing and reading.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import give_back, map_arrow, partitions
from tidemark.llm.units import library_encoder, with_end

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90.0
#: A segment is closed once it has so many ids; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 16
#: Bytes of text that are encoded together: the more, the fewer times a task looks up a unit.
GROUP_BYTES = 4 << 20
#: Up to so many writing tasks their first ids are broadcast to the readers (16 bytes for each); beyond, they are joined by shuffle.
BROADCAST_TASKS = 500_000

SEGMENT_SCHEMA = "task int, segment int, before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, data binary"
_SEGMENT = pa.schema([("task", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("data", pa.binary())])
DOC_SCHEMA = "task int, doc_id long, local_start long, n_tokens long, ids binary"
_DOC = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment of uint32 ids."""
    n = len(ids)
    blocks = -(-n // block)
    table = np.full(blocks * block, ids[-1] if n else 0, np.uint32)
    table[:n] = ids
    table = table.reshape(blocks, block)
    low = table.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = table - low[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    place = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = np.sort(bits, axis=1)[:, place] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    exceptions = np.concatenate([[0], np.cumsum(over.sum(axis=1))]).astype("<u4")
    row, at = np.nonzero(over)
    sizes = (block * width.astype(np.int64) + 7) // 8
    index = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(index[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            cells = np.unpackbits(np.ascontiguousarray(delta[rows].astype("<u4")).view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little", count=int(w))
            out = np.packbits(cells.reshape(len(rows), -1), axis=1, bitorder="little")
            packed[index[rows][:, None] + np.arange(out.shape[1])] = out
    return b"".join([MAGIC, struct.pack("<III", n, block, blocks), index.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), exceptions.tobytes(), packed.tobytes(), at.astype("<u2").tobytes(), delta[row, at].astype("<u4").tobytes()])


class Segment:
    """Reads a segment, whole or by block."""

    def __init__(self, data: bytes | pa.Buffer):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment")
        self.n, self.block, self.blocks = struct.unpack_from("<III", data, 4)
        at = 16

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.index, self.low = take("<u4", self.blocks + 1).astype(np.int64), take("<u4", self.blocks)
        self.width, self.exceptions = take("u1", self.blocks), take("<u4", self.blocks + 1).astype(np.int64)
        self.packed = take("u1", int(self.index[-1]))
        self.place, self.value = take("<u2", int(self.exceptions[-1])), take("<u4", int(self.exceptions[-1]))

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first..last-1 (all by default)."""
        last = self.blocks if last is None else last
        out = np.zeros((last - first, self.block), np.uint32)
        width = self.width[first:last]
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                size = (self.block * int(w) + 7) // 8
                raw = self.packed[self.index[first + rows][:, None] + np.arange(size)]
                cells = np.unpackbits(raw, axis=1, bitorder="little", count=self.block * int(w)).reshape(len(rows), self.block, int(w))
                wide = np.packbits(cells, axis=2, bitorder="little")
                full = np.zeros((len(rows), self.block, 4), np.uint8)
                full[:, :, : wide.shape[2]] = wide
                out[rows] = full.view("<u4")[:, :, 0]
        lo, hi = self.exceptions[first], self.exceptions[last]
        row = np.repeat(np.arange(last - first), np.diff(self.exceptions[first : last + 1]))
        out[row, self.place[lo:hi]] = self.value[lo:hi]
        out += self.low[first:last, None]
        return out.ravel()[: self.n - first * self.block]


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text (null: empty), append `end`, and write segments to path in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id are in the order of their text's hash. A
    doc_id with very many rows is spread over tasks.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = library_encoder(tokenizer), TaskContext.get().partitionId()
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = before = number = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, lengths, held, size, before, number
            out = pa.RecordBatch.from_pydict({"task": [task], "segment": [number], "before": [before], "n_ids": [size], "doc_ids": [keys], "doc_lengths": [np.concatenate(lengths)], "data": [encode(np.concatenate(held))]}, schema=_SEGMENT)
            before, number = before + size, number + 1
            keys, lengths, held, size = [], [], [], 0
            return out

        for batch in batches:
            for lo, hi, ids, bounds in encoder.documents(batch.column(1), GROUP_BYTES):
                ids, bounds = with_end(ids, bounds, end)
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                at = 0
                while at < hi - lo:  # documents up to the one that fills the segment
                    to = min(int(np.searchsorted(bounds, bounds[at] + SEGMENT_IDS - size)), hi - lo)
                    keys += names[at:to]
                    lengths.append(np.diff(bounds[at : to + 1]))
                    held.append(ids[bounds[at] : bounds[to]])
                    size += int(bounds[to] - bounds[at])
                    at = to
                    if size >= SEGMENT_IDS:
                        yield close()
            give_back()
        if keys:
            yield close()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    map_arrow(ordered, run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32) of every document, from the segments at path."""
    segments = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                task, before, data = (row.column(c)[0] for c in ("task", "before", "data"))
                ids = Segment(data.as_buffer()).read().astype("<u4")
                lengths = row.column("doc_lengths").flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(lengths)])
                texts = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                tasks, starts = np.full(len(lengths), task.as_py(), np.int32), ends[:-1] + before.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(tasks), row.column("doc_ids").flatten(), pa.array(starts), pa.array(lengths), texts], schema=_DOC)

    # One row for each writing task: the window below takes one task, over no more rows than that.
    each = segments.groupBy("task").agg(F.sum("n_ids").alias("n"))
    base = each.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    tasks = segments.agg(F.max("task")).first()[0] or 0
    documents = map_arrow(segments.drop("n_ids", "segment"), run, DOC_SCHEMA)
    return documents.join(F.broadcast(base) if tasks < BROADCAST_TASKS else base, "task").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
