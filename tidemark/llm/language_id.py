"""Language identification by cross-parsing: the language in whose labelled text a document falls into the fewest phrases.

For each language a suffix automaton holds every substring of a bounded sample of its
labelled texts. A text is parsed from left to right: a phrase is the longest match that
starts where the last one ended. Phrases times the logarithm of the sample's length
estimate the bits the language needs (Ziv and Merhav). Many segments are parsed in step:
one lookup in a hashed transition table moves them all by a character.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.storage import give_back, map_arrow
from tidemark.sources.code import ship

#: What the fit may hold: the most frequent languages, characters for each and for all together, and texts and characters of one text to take them from.
MAX_LANGUAGES, MAX_CHARS, MAX_ALL_CHARS, MAX_TEXTS, TEXT_CHARS = 256, 40_000, 4_000_000, 400, 2_000
#: A parse begins anew after so many characters, so that one long text is many segments.
SEGMENT = 1_024
#: Characters parsed at once, for each language.
STEP = 2 << 20
UNKNOWN = "und"
_GAP, _STRANGE = 0, 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> str:
    """Lower-case letters (and marks on them), every run of other characters one space."""
    import unicodedata

    out = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower())
    return " ".join(out.split())


def automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the suffix automaton of text; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


@dataclass(frozen=True)
class Model:
    """languages, the lengths of their samples, and their automata's transitions as rows of (state, code point, next state); starts: each one's first state."""

    languages: tuple[str, ...]
    chars: tuple[int, ...]
    starts: tuple[int, ...]
    edges: np.ndarray
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


def learn(samples: dict[str, tuple[int, np.ndarray]]) -> Model:
    """From each language's sample length and transitions, states numbered from 0."""
    names = sorted(samples)
    starts, edges, base = [], [], 0
    for name in names:
        e = samples[name][1]
        starts.append(base)
        edges.append(np.column_stack([e[:, 0] + base, e[:, 1], e[:, 2] + base]))
        base += int(e[:, [0, 2]].max(initial=0)) + 1
    return Model(tuple(names), tuple(samples[n][0] for n in names), tuple(starts), np.concatenate(edges) if edges else np.zeros((0, 3), np.int64))


def transitions(text: str) -> np.ndarray:
    rows = [(s, ord(c), t) for s, out in enumerate(automaton(text)) for c, t in out.items()]
    return np.array(rows, np.int64).reshape(-1, 3)


class Parser:
    """phrases(codes, bounds): the phrases of segments of text under every language of a model."""

    def __init__(self, model: Model):
        import sys
        import unicodedata

        self.model = model
        known = np.unique(model.edges[:, 1])
        known = known[known != 0x20]
        self._symbols = len(known) + 2
        # A character's symbol: letters in lower case, gaps for the rest. Marks belong to letters.
        table = np.zeros(sys.maxunicode + 1, np.uint16 if self._symbols < 1 << 16 else np.int32)
        of = dict(zip(known.tolist(), range(2, len(known) + 2), strict=True))
        self._letter = np.zeros(sys.maxunicode + 1, bool)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha() or unicodedata.category(c)[0] == "M":
                table[i] = of.get(i, _STRANGE)
                self._letter[i] = c.isalpha()
        self._table = table
        state, symbol = model.edges[:, 0], np.where(model.edges[:, 1] == 0x20, _GAP, np.searchsorted(known, model.edges[:, 1]) + 2)
        self._hash(state * self._symbols + symbol, model.edges[:, 2])

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(int(len(keys) * 3).bit_length(), 4)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = ((keys.astype(np.uint64) * _FACTOR) >> self._shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self._keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._keys[slot[put]], self._values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & self._mask

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The states that the keys lead to, -1 where none."""
        slot = ((keys.astype(np.uint64) * _FACTOR) >> self._shift).astype(np.int64)
        have = self._keys[slot]
        out = np.where(have == keys, self._values[slot], -1)
        left = np.flatnonzero((have != keys) & (have >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self._mask
            have = self._keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = self._values[slot[left[hit]]]
            left = left[~hit & (have >= 0)]
        return out

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """The symbols of a text, runs of gaps as one and none at the ends, and whether it has a letter."""
        out, has, gap = [], False, True
        for lo in range(0, len(text), STEP):
            points = np.frombuffer(text[lo : lo + STEP].lower().encode("utf-32-le", "replace"), np.uint32)
            s = self._table[points]
            keep = s != _GAP
            keep[1:] |= keep[:-1].copy()
            keep[0] |= not gap
            gap = bool(s[-1] == _GAP)
            out.append(s[keep])
            has |= bool(self._letter[points].any())
        s = np.concatenate(out) if out else self._table[:0]
        return s[: len(s) - 1 if len(s) and s[-1] == _GAP else len(s)], has

    def phrases(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases under each language (columns) of segments of the symbols that begin at `first` (ascending) and end where the next one begins."""
        n, languages = len(first), len(self.model.languages)
        size = np.diff(first, append=len(symbols))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        start = np.array(self.model.starts, np.int64)
        state = np.tile(start, (n, 1))
        roots = state.copy()
        count = np.zeros((n, languages), np.int32)
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if n else np.zeros(0, int)
        for j, k in enumerate(live.tolist()):
            s = symbols[first[:k] + j].astype(np.int64)[:, None]
            key = state[:k] * self._symbols + s
            to = self._next(key.ravel()).reshape(k, languages)
            ends = to < 0
            if ends.any():
                # The character that does not fit begins the next phrase; one that the language lacks is a phrase by itself.
                at, lang = np.nonzero(ends)
                count[at, lang] += (state[at, lang] != start[lang]).astype(np.int32)
                again = self._next(start[lang] * self._symbols + s[at, 0])
                lost = again < 0
                count[at, lang] += lost.astype(np.int32)
                to[at, lang] = np.where(lost, start[lang], again)
            state[:k] = to
        count += state != roots
        out = np.empty_like(count)
        out[order] = count
        return out

    def languages(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Each text's language and its share of the likelihood under all languages."""
        rows, has = [], []
        for t in texts:
            s, letter = self.symbols(t or "")
            rows.append(s)
            has.append(letter)
        n, lo = len(rows), 0
        total = np.zeros((n, len(self.model.languages)), np.int64)
        sizes = np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(sizes)
        while lo < n:  # some MB at a time; a longer text alone, its segments in parts
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")), lo + 1)
            symbols = np.concatenate(rows[lo:hi])
            for a in range(0, len(symbols) if hi == lo + 1 else 1, STEP):
                part = symbols[a : a + STEP] if hi == lo + 1 else symbols
                length = sizes[lo:hi] if hi > lo + 1 else np.array([len(part)])
                parts = -(-length // SEGMENT)
                owner = np.repeat(np.arange(lo, hi), parts)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = np.repeat(np.cumsum(length) - length, parts) + inside * SEGMENT
                np.add.at(total, owner, self.phrases(part, first))
            lo = hi
        bits = total * np.array([math.log2(max(c, 2)) for c in self.model.chars])
        names, scores = [], []
        for b, letter in zip(bits, has, strict=True):
            if not letter or not len(b):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(b.argmin())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(b[best] - b, -1000.0)).sum()))
        return names, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows: of each of the MAX_LANGUAGES most frequent languages, MAX_CHARS letters of the texts that are least by a hash, TEXT_CHARS from a hashed place of each.

    Equal texts teach once. Rows without a text or a language teach nothing. The driver
    holds the automata (three transitions for a character at most) of MAX_ALL_CHARS.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return learn({})
    most = min(MAX_CHARS, MAX_ALL_CHARS // len(counts))
    # Of about 4 times as many texts as needed, the least hashes: what a task keeps and sends is bounded.
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(4.0 * MAX_TEXTS / r["count"], 1.0)))))
    h = F.xxhash64("text")
    rows = rows.withColumn("h", h).where(F.col("lang").isin([r["lang"] for r in counts]) & (F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "h", F.col("text").substr(place, F.lit(TEXT_CHARS)).alias("text")).dropDuplicates(["lang", "h"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= MAX_TEXTS)

    def build(x: pd.DataFrame) -> pd.DataFrame:
        sample = " ".join(map(letters, x.sort_values("rank")["text"]))[:most]
        return pd.DataFrame({"lang": [x["lang"].iloc[0]], "chars": [len(sample)], "edges": [transitions(sample).tobytes()]})

    made = rows.groupBy("lang").applyInPandas(build, "lang string, chars long, edges binary").collect()
    return learn({r["lang"]: (r["chars"], np.frombuffer(r["edges"], np.int64).reshape(-1, 3)) for r in made if r["chars"]})


_parsers: dict[str, Parser] = {}


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without `text`, with lang_pred (string) and score (double, 0 to 1: the language's share of the likelihood).

    Every whole text is parsed. Null texts, texts without a letter, and all texts where
    the model knows no language: `und` and 0. Columns of these names are replaced; an
    empty table gives no rows. Of equal languages the first by name wins.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parsers.get(sent.value.uid)
        if parser is None:
            _parsers.clear()
            parser = _parsers[sent.value.uid] = Parser(sent.value)
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < whole.num_rows:
                hi = max(int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STEP, side="right")), lo + 1)
                batch = whole.slice(lo, hi - lo)
                names, scores = parser.languages(batch.column(at).to_pylist())
                kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != at]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[n for n, _ in kept] + ["lang_pred", "score"])
                lo = hi
            give_back()

    return map_arrow(docs, run, schema)


def held_out(key: Column | str) -> Column:
    """Whether crc32 of the key as text, modulo 4, is 2; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))) % 4 == 2
