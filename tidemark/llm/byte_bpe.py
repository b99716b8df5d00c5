"""Byte-level BPE by matrices: rows are pre-tokens, padded to the width of their length bucket.

In each round every row merges its leftmost pair of the smallest rank: the pair's
token takes the left cell and the rest of the row moves up. Ranks of pairs come from
an open-addressing table in numpy. A row without a pair leaves the matrix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.storage import give_back, map_arrow
from tidemark.llm.units import UnitEncoder

_NONE = np.int32(2**31 - 1)
#: Cells of one matrix; bounds the memory of a round.
CELLS = 1 << 19
#: Rows longer than this are merged alone, all non-overlapping occurrences of a pair at once where that gives the same result.
LONG = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of each pair of ids whose joined bytes are a token, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        k, v = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(4, int(len(k) * 8).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, ~np.uint64(0), np.uint64), np.full(1 << bits, _NONE, np.int32)
        slot = (k * _MULTIPLIER >> self._shift).astype(np.int64)
        self.probes = 1
        while len(k):
            free = self._keys[slot] == ~np.uint64(0)
            chosen = np.zeros(len(k), bool)
            chosen[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            chosen &= free
            self._keys[slot[chosen]], self._values[slot[chosen]] = k[chosen], v[chosen]
            k, v, slot = k[~chosen], v[~chosen], slot[~chosen] + 1 & self._mask
            self.probes += bool(len(k))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; no rank where a pair is no token, or an id is negative."""
        key = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.int64).view(np.uint64)
        slot = (key * _MULTIPLIER >> self._shift).astype(np.int64)
        out = np.where(self._keys[slot] == key, self._values[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self._keys[slot] != ~np.uint64(0)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            s = slot.ravel()[open_] = slot.ravel()[open_] + 1 & self._mask
            hit = self._keys[s] == key.ravel()[open_]
            out.ravel()[open_[hit]] = self._values[s[hit]]
            open_ = open_[~hit & (self._keys[s] != ~np.uint64(0))]
        bad = (left < 0) | (right < 0)
        out[bad] = _NONE
        return out


class MatrixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self._ranks, self._pairs = ranks, PairTable(ranks)
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that is itself a token is that token."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self._ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self._long(self._byte[np.frombuffer(p, np.uint8)])
            else:
                by.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in by.items():
            for lo in range(0, len(rows), step := max(1, CELLS // width)):
                some = rows[lo : lo + step]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        n = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < n[:, None], self._byte[raw], np.int32(-1))
        out: list[np.ndarray | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        rank = self._pairs.ranks(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i, : n[i]].copy()
                live = ~done
                row, ids, rank, n, at, best = row[live], ids[live], rank[live], n[live], at[live], best[live]
                if not len(row):
                    break
            every = np.arange(len(row))
            ids[every, at] = best
            move = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            n = n - 1
            ids[every, n] = -1
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], width - 2), axis=1)
            rank[every, np.minimum(n - 1, width - 2)] = _NONE
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                s = side[ok]
                rank[ok, s] = self._pairs.ranks(ids[ok, s], ids[ok, s + 1])
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        rank = self._pairs.ranks(ids[:-1], ids[1:])
        while len(ids) > 1 and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping occurrences every second one, from the left
                new = np.ones(len(at), bool)
                new[1:] = np.diff(at) > 1
                start = np.flatnonzero(new)
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) % 2 == 0]
            merged, ranks = self._merge(ids, at, best)
            if len(at) > 1 and ranks.min() < best:  # an earlier pair arises: it comes before the next occurrence
                merged, ranks = self._merge(ids, at[:1], best)
            ids, rank = merged, ranks
        return ids

    def _merge(self, ids: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
        ids = ids.copy()
        ids[at] = token
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        return ids, self._pairs.ranks(ids[:-1], ids[1:]) if len(ids) > 1 else np.array([_NONE])


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def matrix_encoder(path: str, pattern: str) -> UnitEncoder:
    """A worker's encoder by the ranks at path, each match of pattern separately."""
    have = _encoders.get((path, pattern))
    if have is None:
        import regex

        bpe, match = MatrixBPE(read_ranks(path)), regex.compile(pattern)

        def encode(units: list[bytes]) -> list[bytes]:
            pieces = [[x.encode() for x in match.findall(u.decode())] for u in units]
            known = list({x for p in pieces for x in p})
            ids = {x: i.astype("<u4").tobytes() for x, i in zip(known, bpe.encode(known), strict=True)}
            return [b"".join(map(ids.__getitem__, p)) for p in pieces]

        have = _encoders[path, pattern] = UnitEncoder(encode)
    return have


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without `text`, with token_ids (array of int), as the tiktoken library gives without special tokens.

    Null and empty texts have no ids. A column named token_ids is replaced; repeated rows
    stay; an empty table gives an empty one.
    """
    docs = docs.drop("token_ids")
    at = docs.columns.index(text)
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = matrix_encoder(path, pattern)
        for batch in batches:
            for lo, hi, ids, bounds in encoder.documents(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at] + [lists], names=[n for i, n in enumerate(part.schema.names) if i != at] + ["token_ids"])
            give_back()

    return map_arrow(docs, run, schema)


class TokenBytes:
    """Every token's bytes in one array, to gather the bytes of many ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        by = dict(zip(ranks.values(), ranks, strict=True))
        self._known = np.zeros(max(by) + 1, bool)
        self._known[list(by)] = True
        tokens = [by.get(i, b"") for i in range(max(by) + 1)]
        self._size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._first = np.cumsum(self._size) - self._size
        self._data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids in a row, and the bytes before each id (one longer)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._known) or not self._known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self._size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self._first[ids] - ends[:-1], size)
        place += np.arange(len(place))
        return self._data[place], ends


_tokens: dict[str, TokenBytes] = {}
#: Rows that are decoded at once.
DECODED_ROWS = 200


def bpe_decode(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """encoded with decoded (binary): the bytes of the ids in a row; null ids: null. A column named decoded is replaced. Unknown ids raise; an empty table gives an empty one."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids)
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokens.get(path)
        if table is None:
            table = _tokens[path] = TokenBytes(read_ranks(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(lo, DECODED_ROWS)
                lists = part.column(at)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, ends = table.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                bounds = ends[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(lists), [lists.is_valid().buffers()[1], pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, "decoded"])
            give_back()

    return map_arrow(encoded, run, schema)
