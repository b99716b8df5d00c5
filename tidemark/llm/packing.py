"""Packing by power-of-two decomposition: every document is cut into pieces of power-of-two length.

A document's tokens are cut from its start into pieces of the longest allowed length
and then the binary digits of the rest, longest first. Each piece is a sequence of its
own, so none crosses documents and none needs padding. Sequences of equal length form a
bucket: rows are dealt by bucket and a hash of their place in the corpus, so that a
bucket of any size is spread, and come bucket by bucket out of every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import give_back, map_arrow, partitions
from tidemark.llm.units import library_encoder, with_end

MAX_LENGTH = 4096
PACKED_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, bucket int, offset long, ids binary"
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("bucket", pa.int32()), ("offset", pa.int64()), ("ids", pa.binary())])


def cuts(n: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Owner (number in n) and length of all pieces of documents of n tokens each, in order."""
    n = np.asarray(n, np.int64)
    sizes = longest >> np.arange(1, longest.bit_length())
    lengths = np.concatenate([np.full((len(n), 1), longest), np.broadcast_to(sizes, (len(n), len(sizes)))], axis=1)
    times = np.concatenate([(n // longest)[:, None], ((n % longest)[:, None] & sizes) > 0], axis=1)
    return np.repeat(np.arange(len(n)), times.sum(axis=1)), np.repeat(lengths.ravel(), times.ravel())


def pack(docs: DataFrame, path: str, end: int, text: str = "text", doc_id: str = "doc_id", longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece (PACKED_SCHEMA); ids are little-endian uint32.

    A document's tokens are those of the tokenizers library and the file at path, and
    then `end`; a null or empty text is `end` alone. bucket is log2 of the length;
    sequence_id has it in its top bits, then the task and the piece's number in it:
    unique, and sorted by bucket. offset is 0. Null doc_id stays null; repeated rows are
    separate; an empty table gives no rows; other columns of docs are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, done = library_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, bounds in encoder.documents(batch.column(1)):
                ids, bounds = with_end(ids, bounds, end)
                n = np.diff(bounds)
                owner, length = cuts(n, longest)
                at = np.concatenate([[0], np.cumsum(length)])
                bucket = np.frexp(length)[1] - 1
                number = done + np.arange(len(length))
                done += len(length)
                for a in range(0, len(length), 20_000):
                    z = min(a + 20_000, len(length))
                    data = pa.py_buffer(np.ascontiguousarray(ids[at[a] : at[z]], "<u4"))
                    pieces = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((4 * (at[a : z + 1] - at[a])).astype(np.int32)), data])
                    some = owner[a:z]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                            pa.array(at[a:z] - bounds[some]),
                            pa.array(length[a:z]),
                            pa.array(n[some]),
                            pa.array(bucket[a:z].astype(np.int64) << 57 | task << 36 | number[a:z]),
                            pa.array(bucket[a:z].astype(np.int32)),
                            pa.array(np.zeros(z - a, np.int64)),
                            pieces,
                        ],
                        schema=_PACKED,
                    )
            give_back()

    packed = map_arrow(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), run, PACKED_SCHEMA)
    return packed.repartition(partitions(docs.sparkSession), "bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 16))).sortWithinPartitions("bucket")
