"""Phrase mining against a plain version that counts every phrase."""

import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import collocations as co
from tidemark.llm.collocations import collocations, slices

SCHEMA = "doc_id long, lang string, text string, phrase string, n int"


def pieces(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", t)]


def plain(rows, least, top, percent=80):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= percent * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def corpus(seed, n=200):
    r = random.Random(seed)
    vocabulary = ["a", "b", "of", "the", "Été", "état", "x\x00", "日本", "don't", "z z"]
    rows = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("en", " ., \n"), ("de", "the same line again " * 3000), ("de", "One, " * 50), rows[0], rows[0]]


def test_collocations_equal_a_plain_version(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(1, *x, "p", 9) for x in rows], SCHEMA).repartition(5)
    for least, top in ((3, 25), (30, 2000)):
        got = collocations(docs, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(x) for x in got.collect()} == plain(rows, least, top)
    assert collocations(docs.limit(0), 3).count() == 0
    assert collocations(docs.where("text IS NULL")).count() == 0


def counted(texts, k, step):
    """Phrases of k words as slices of `step` bytes show them."""
    out = Counter()
    for text in texts:
        for part, old in slices(np.frombuffer(text, np.uint8), step):
            words = co.Words(part, np.array([0, len(part)]), np.zeros(1, np.int32), old)
            d = words.dictionary.to_pylist()
            for i in words.fresh(np.flatnonzero(words.whole(k)), k):
                out[b" ".join(d[j] for j in words.ids[i : i + k])] += 1
    return out


def test_slices_of_a_long_text_lose_and_repeat_nothing():
    r = random.Random(5)
    texts = ["".join(r.choice(["aé", "B", "cc", "word" * 20]) + r.choice([" ", " ", "\t", " . ", "\n"]) for _ in range(300)).encode(), b"x" * 500, b"no cut " * 200, b" " * 100, b"", b"a" * 90 + b" b"]
    for k in range(1, 5):
        want = Counter(b" ".join(x.encode() for x in w[i : i + k]) for t in texts for w in pieces(t.decode()) for i in range(len(w) - k + 1))
        for step in (1, 7, 40, 10_000):
            assert counted(texts, k, step) == want


def test_counts_are_merged_and_sent_as_they_grow(monkeypatch):
    monkeypatch.setattr(co, "HELD_ROWS", 4)
    monkeypatch.setattr(co, "HELD_BUCKETS", 4)
    counts, found, pages = co.Counts(30), Counter(), Counter()

    def take(batches):
        for b in batches:
            for x in b.to_pylist():
                if x["page"] is None:
                    found[x["phrase"]] += x["n"]
                else:
                    for p, n in zip(np.frombuffer(x["places"], np.uint16).tolist(), np.frombuffer(x["counts"], np.uint8).tolist(), strict=True):
                        pages[x["page"] * co.PAGE + p] += n

    import pyarrow as pa

    langs = pa.array([b"en"], pa.large_binary())
    for text in (b"a b c d", b"a b a b", b"e f g", b"a b"):
        w = co.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.int32))
        h = co.binary_hashes(w.dictionary)
        counts.phrases(w, np.flatnonzero(w.whole(2)), 2, langs, co.binary_hashes(langs), h, 20)
        counts.buckets(np.array([1, 70_000, 1], np.uint64))
        take(counts.full())
    take(counts.rest())
    assert found == Counter({b"a b": 4, b"b c": 1, b"c d": 1, b"b a": 1, b"e f": 1, b"f g": 1})
    assert pages == Counter({1: 8, 70_000: 4})
