"""Encoding whole texts unit by unit: a unit is cut where every supported pre-tokenizer cuts too.

The pre-tokenizers split a text so that no pre-token runs over a space that is followed
by something other than white space (the space opens a new pre-token), and so that a
lone line end between other characters is a pre-token of its own. Texts are cut there,
as byte offsets over an Arrow column; Arrow dictionary-encodes the units of a group of
texts, each distinct unit is encoded once in a worker's cache, and the ids of all units
are gathered by offset: the same ids as encoding each text whole.

No unit begins where a string of the vocabulary's added tokens may begin, so such a
string stays with what stands before it, and the library finds it as in the whole text.
Units also end between an ASCII letter and an ASCII mark other than an apostrophe, where
letters and marks are pre-tokens apart; not in a run of texts that holds such a string.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm import hashing as H
from tidemark.llm.blocks import texts
from tidemark.llm.storage import cache

#: Units kept in a worker's cache; bounds its memory.
CACHE_UNITS = 300_000
#: Bytes of text that are cut and encoded together; a longer text is taken in such steps.
GROUP_BYTES = 2 << 20

#: Units that are encoded by one call, and the sign between them.
JOINED, MARK = 64, b"\x01"
#: Letters 1, marks 2, all else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[0x27] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of the characters among which there is white space outside ASCII, and last bytes of such white space.
_MAY_OPEN_BLANK = [0xC2, 0xE1, 0xE2, 0xE3]
_MAY_CLOSE_BLANK = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]

_ODD = _BLANK.copy()
_ODD[[*_MAY_OPEN_BLANK, MARK[0], ord("<")]] = True


class UnitEncoder:
    """encode(units) gives each unit's ids as little-endian uint32 bytes; documents() gives those of whole texts.

    added: strings that stand for a token wherever they occur; whole: never cut.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], added: tuple[bytes, ...] = (), whole: bool = False):
        self._encode, self._whole, self._added = encode, whole, added
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._opens, self._closes = ~_BLANK, ~_BLANK
        self._opens[[*_MAY_OPEN_BLANK, *(x[0] for x in added)]] = False
        self._marks = _KIND.copy()
        self._marks[[x[0] for x in added]] = 0
        self._closes[_MAY_CLOSE_BLANK] = False

    def documents(self, column: pa.Array, group: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """first, last + 1, ids (uint32) and offsets in them of runs of the column's texts (null: an empty text)."""
        data, offsets = texts(column)
        for lo, hi in H.chunks(offsets, group):
            begin, end = int(offsets[lo]), int(offsets[hi])
            ids, bounds, done, at = [], np.zeros(hi - lo + 1, np.int64), 0, begin
            while at < end:
                stop = self._stop(data, at, end, group)
                got, ends, starts = self._encoded(data[at:stop], offsets[lo : hi + 1] - at)
                inside = (offsets[lo : hi + 1] > at) & (offsets[lo : hi + 1] <= stop)
                bounds[inside] = done + ends[np.searchsorted(starts, offsets[lo : hi + 1][inside] - at)]
                ids.append(got)
                done, at = done + len(got), stop
            bounds = np.maximum.accumulate(bounds)
            yield lo, hi, np.concatenate(ids) if ids else np.zeros(0, np.uint32), bounds

    def _stop(self, data: np.ndarray, at: int, end: int, group: int) -> int:
        """Where a step from `at` ends: at the end, or for one long text before the first unit after a step's length."""
        if end - at <= 2 * group or self._whole:
            return end
        lo = at + group
        while lo < end:
            cut = np.flatnonzero(self._cuts(data[lo - 1 : min(lo + group, end)], np.zeros(0, np.int64), False)[1:])
            if len(cut):
                return lo + int(cut[0])
            lo += group
        return end

    def _cuts(self, data: np.ndarray, edges: np.ndarray, marks: bool = True) -> np.ndarray:
        """Where units begin in data, a run of texts that begin at edges too. marks: also between letters and marks."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1 and not self._whole:
            edge = np.zeros(len(data) + 1, bool)
            edge[edges] = edge[0] = True
            opens = self._opens[data[1:]] & ~edge[1:-1]
            cut[:-2] = (data[:-1] == 0x20) & opens
            line = np.flatnonzero((data[:-1] == 0x0A) & opens)
            line = line[~edge[line]]
            line = line[self._closes[data[line - 1]]]
            cut[line] = cut[line + 1] = True
            if marks and not (self._added and any(x in raw for raw in [data.tobytes()] for x in self._added)):
                kind = self._marks[data]
                cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut[edges] = True
        return cut[:-1]

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, the ids before each unit (one longer), and the units' first bytes."""
        cut = self._cuts(data, offsets[(offsets > 0) & (offsets < len(data))])
        cut[:1] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, at, raw = units.dictionary.buffers()
        raw, at = raw.to_pybytes() if raw is not None else b"", np.frombuffer(at, np.int32, len(units.dictionary) + 1).tolist()
        have = self._known([raw[a:z] for a, z in zip(at, at[1:], strict=False)])
        size = np.fromiter(map(len, have), np.int64, len(have)) // 4
        flat = np.frombuffer(b"".join(have), "<u4")
        which = units.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n)
        place += np.arange(len(place))
        return flat[place], ends, starts

    def _known(self, units: list[bytes]) -> list[bytes]:
        # Two generations: when the young one is full it becomes the old one, so units in use outlive the rest.
        if len(self._young) > CACHE_UNITS // 2:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        have = list(map(young.get, units))
        new = []
        for i, ids in enumerate(have):
            if ids is None:
                if (ids := old.get(units[i])) is None:
                    new.append(i)
                else:
                    have[i] = young[units[i]] = ids
        for i, ids in zip(new, self._encode([units[i] for i in new]), strict=True):
            have[i] = young[units[i]] = ids
        return have


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text's, and the offsets of the longer texts."""
    longer = bounds + np.arange(len(bounds))
    out = np.full(int(longer[-1]), end, np.uint32)
    own = np.ones(len(out), bool)
    own[longer[1:] - 1] = False
    out[own] = ids
    return out, longer


def _alone(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which units are not joined with others: those with (what may be) white space but for one leading space, nothing else, the sign between units, or what may begin an added token. And which of the others have that space."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    data = np.frombuffer(b"".join(units), np.uint8)
    first = np.cumsum(size) - size
    odd = _ODD[data]
    led = size > 1
    led[led] = data[first[led]] == 0x20
    odd[first[led]] = False
    n = np.concatenate([[0], np.cumsum(odd)])
    alone = (n[first + size] > n[first]) | (size == 0)
    return alone, led & ~alone


def _space_tokens(path: str) -> np.ndarray | None:
    """By id, whether a token begins with a space; None unless texts go unchanged, byte by byte, into pre-tokens that a space may only open."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, model = t["pre_tokenizer"] or {}, t["model"]
    if t["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return None
    out = np.zeros(1 + max(max(model["vocab"].values()), *(x["id"] for x in t["added_tokens"]), 0), bool)
    out[[i for x, i in model["vocab"].items() if x.startswith("\u0120")]] = True
    return out


_library: dict[str, UnitEncoder] = {}
cache(_library.clear)


def library_encoder(path: str) -> UnitEncoder:
    """A worker's encoder by the tokenizers library and the file at path, add_special_tokens=False and nothing else: the strings of added tokens in a text become those tokens."""
    have = _library.get(path)
    if have is None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        whole = any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(c.isspace() for c in x["content"]) for x in added)

        def each(strings: list[bytes]) -> list[np.ndarray]:
            return [np.array(e.ids, "<u4") for e in t.encode_batch_fast([x.decode() for x in strings], add_special_tokens=False)]

        # Calls cost more than most units: units are joined by a line of a sign that is one token, where the library keeps them apart.
        line, sign, letter, probe = each([b"\n", MARK, b"a", b"a\n" + MARK + b"\na"])
        joins = len(line) < 2 and len(sign) == 1 and probe.tolist() == [*letter, *line, *sign, *line, *letter]

        # Where a space opens a pre-token and its first token, units that open with one need no sign between them.
        opens = _space_tokens(path) if joins else None

        def together(units: list[bytes], sign: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
            runs = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
            return zip(runs, each([sign.join(x) for x in runs]), strict=True)

        def encode(units: list[bytes]) -> list[bytes]:
            alone, led = _alone(units) if joins else (np.ones(len(units), bool), np.zeros(len(units), bool))
            if opens is None:
                led[:] = False
            out = np.empty(len(units), object)
            out[alone] = [x.tobytes() for x in each([units[i] for i in np.flatnonzero(alone)])]
            joined: list[bytes] = []
            for run, x in together([units[i] for i in np.flatnonzero(led)], b""):
                raw, at = x.tobytes(), 4 * np.flatnonzero(opens[x])
                if len(at) != len(run):
                    raise ValueError("a token of a unit's first character is missing")
                joined += [raw[a:z] for a, z in zip(at.tolist(), [*at[1:].tolist(), len(raw)], strict=True)]
            out[led] = joined
            rest = ~alone & ~led
            joined = []
            for _, x in together([units[i] for i in np.flatnonzero(rest)], b"\n" + MARK + b"\n"):
                raw, at = x.tobytes(), np.flatnonzero(x == sign[0])
                starts, ends = 4 * np.concatenate([[0], at + 1 + len(line)]), 4 * np.append(at - len(line), len(x))
                joined += [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            out[rest] = joined
            return out.tolist()

        have = _library[path] = UnitEncoder(encode, tuple(x["content"].encode() for x in added), whole)
    return have
