"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from tidemark.llm.importance import resample

SCHEMA = "doc_id long, text string, rank string, n_words int, s int"


def features(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(rows, target, percent=25, min_words=20):
    docs = [(key, *features(t)) for key, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0))))
    out = []
    for key, n, f in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    rank = {id(x): i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return Counter((x[0], x[2], x[3], x[4], rank.get(id(x))) for x in out)


def test_resample_equals_a_plain_version(spark):
    words = "the Éclair of and ÉTÉ naïve x1 Tide mark über 日本 don't a_b 42".split()
    rows = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(i % 60))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " ,.\n"), (None, rows[50][1]), (50, rows[50][1]), (50, rows[50][1]), (503, "Word, " * 40000), (504, "x\x00y\x7fz " * 20)]
    target = ["the tide of the mark", None, "", "Über the éclair"]
    docs = spark.createDataFrame([(k, t, "extra", 1, 2) for k, t in rows], SCHEMA).repartition(3)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, benchmark)
    assert got.columns == ["doc_id", "n_words", "s", "n_features", "weight", "score", "rank"]
    found = got.collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == plain(rows, target)
    drawn = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert drawn == list(range(1, len(drawn) + 1))


def test_resample_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "word " * 30, "", 0, 0), (2, "tide " * 30, "", 0, 0)], SCHEMA), spark.createDataFrame([], "text string")
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(docs, none, percent=100).collect()) == plain([(1, "word " * 30), (2, "tide " * 30)], [], 100)
    assert resample(docs.limit(0), docs.select("text")).count() == 0
