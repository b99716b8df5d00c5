"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Each node has a failure link (the node of
what is left once the longest pieces are popped) and the number of pieces popped on
the way, so a word's greedy longest-match piece count takes time linear in its bytes
and builds no piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.byte_bpe import read_ranks
from tidemark.llm.storage import map_arrow

#: Counts kept in a worker's cache before it starts anew.
CACHE_WORDS = 500_000


class Automaton:
    """count(word): pieces of the greedy longest match, or 1 (unknown) where that fails."""

    def __init__(self, vocabulary: Iterable[bytes]):
        goto: dict[int, int] = {}
        final, parent, label = [False], [0], [0]
        children: list[list[int]] = [[]]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                nxt = goto.get(node << 8 | byte)
                if nxt is None:
                    nxt = goto[node << 8 | byte] = len(final)
                    final.append(False)
                    parent.append(node)
                    label.append(byte)
                    children.append([])
                    children[node].append(nxt)
                node = nxt
            if node:
                final[node] = True
        fail, popped = [-1] * len(final), [0] * len(final)
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            u = parent[v]
            z, n = fail[u], popped[u]
            while z >= 0 and (z << 8 | label[v]) not in goto:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = goto[z << 8 | label[v]], n
        self._goto, self._fail, self._popped = goto, fail, popped

    def count(self, word: bytes) -> int:
        goto, fail, popped = self._goto.get, self._fail, self._popped
        node = n = 0
        for byte in word:
            nxt = goto(node << 8 | byte)
            while nxt is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
                nxt = goto(node << 8 | byte)
            node = nxt
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


_counters: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", marker: bytes = b" ") -> DataFrame:
    """docs without `text`, with n_words and n_pieces (long).

    Words are maximal runs of bytes other than ASCII white space; a word's pieces are
    the greedy longest match of `marker` + word over the byte strings of the vocabulary
    at path; a word that cannot be matched counts one piece. Null and empty texts: 0 and
    0. Columns named n_words or n_pieces are replaced; an empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_pieces")
    at = docs.columns.index(text)
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Automaton(read_ranks(path)), {}
        automaton, cache = _counters[path]
        for batch in batches:
            n_words, n_pieces = [], []
            for t in batch.column(at):
                words = (t.as_py() or "").encode().split()
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = automaton.count(marker + w)
                n_words.append(len(words))
                n_pieces.append(sum(map(cache.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], names=[n for i, n in enumerate(batch.schema.names) if i != at] + ["n_words", "n_pieces"])

    return map_arrow(docs, run, schema)
