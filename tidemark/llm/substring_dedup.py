"""Substring dedup: words covered by a word window that occurs twice or more in the corpus are removed.

Rabin-Karp fingerprints of every window of `k` words are counted over the whole
corpus (see blocks); repeated windows merge into maximal intervals of words, which
are cut from each text. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import hashing as H
from tidemark.llm.blocks import Blocks, Order, covered, each_row, pieces, reply, send, to_blocks, unpack, with_replies
from tidemark.llm.storage import map_arrow

WINDOW = 35


def _fingerprints(batch: pa.RecordBatch, at: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both fingerprints and the first word of every window of a block, and each text's first word (one longer)."""
    h1, h2, starts, first, n = [], [], [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in pieces(batch, at):
        begin, end, fw = H.words(data, offsets)
        values = H.word_hashes(data, begin, end)
        w = H.windows(values, fw, k)
        h1.append(H.rolling(values, w, k))
        h2.append(H.rolling(values, w, k, H.SECOND_BASE))
        starts.append(w + n)
        first.append(fw[1:] + n)
        n += len(begin)
    return np.concatenate(h1), np.concatenate(h2), np.concatenate(starts), np.concatenate(first)


def substring_dedup(docs: DataFrame, text: str = "text", k: int = WINDOW) -> DataFrame:
    """docs with `text` cut, and n_words and n_removed (long) beside it.

    A word is a maximal run of bytes other than ASCII white space. A run of removed words
    goes with the white space behind it; all other white space stays, so a text that
    keeps all its words stays as it is. Null text: no words, and null comes out. Texts of
    fewer than k words have no window and lose nothing. Repeated rows are separate
    documents, so both lose all their windows. Columns of docs named n_words or n_removed
    are replaced. Rows are neither added nor dropped; an empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_removed")
    b = to_blocks(docs, text)
    return cut(b, k)


def cut(b: Blocks, k: int) -> DataFrame:
    at, buckets = b.schema.fieldNames().index(b.text), b.buckets(b.n_words)

    def emit(row: dict) -> Iterator[pa.RecordBatch]:
        yield Order(*_fingerprints(unpack(row["payload"]), at, k)[:2], buckets).rows(row["block"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            batch = unpack(row["payload"])
            h1, h2, starts, first = _fingerprints(batch, at, k)
            order = Order(h1, h2, buckets)
            del h1, h2
            seen = (order.answers(row["replies"], False) | (order.counts > 1))[order.rank]
            del order
            gone = covered(starts[seen], k, int(first[-1]))
            del starts, seen
            yield from _outputs(batch, at, gone, first)

    sent = send(b.table.select("block", "payload"), emit)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in b.schema] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return map_arrow(with_replies(b.table.select("block", "payload"), reply(sent, buckets)), finish, schema)


def _outputs(batch: pa.RecordBatch, at: int, gone: np.ndarray, first: np.ndarray, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        column = part.column(at)
        cut = removed[lo : lo + rows] > 0
        if cut.any():
            texts = column.to_pylist()
            for i in np.flatnonzero(cut):
                texts[i] = _without(texts[i].encode(), gone[first[lo + i] : first[lo + i + 1]]).decode()
            column = pa.array(texts, column.type)
        columns = part.columns
        columns[at] = column
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n[lo : lo + rows], pa.int64()), pa.array(removed[lo : lo + rows], pa.int64())], names=[*part.schema.names, "n_words", "n_removed"])


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """text without its words that are gone and the white space behind each run of them (the last word: none)."""
    begin, end, _ = H.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    kept, at = [], 0
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        kept.append(text[at : begin[a]])
        at = int(begin[z]) if z < len(begin) else int(end[z - 1])
    return b"".join([*kept, text[at:]])
