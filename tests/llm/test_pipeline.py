"""The pipeline and its stages on a small corpus against plain versions, and the operators on odd tables."""

import collections
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.quality_rules import DecisionList, apply_rules, fit, keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = text(60)
    docs = [(i, text(r.randint(60, 200))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]  # exact copies
    docs += [(110 + i, docs[i][1] + " tail") for i in range(5, 10)]  # near copies
    docs += [(120 + i, f"def f{i}():\n\tx = 1\n\n{text(80)}\n    {shared}\n\n{text(40)}\n") for i in range(4)]  # a passage in several
    docs += [(130 + i, " ".join(w + r.choice(["###", "$$", "%", "**"]) for w in text(70).split())) for i in range(30)]  # junk
    docs += [(200, None), (201, ""), (202, " \n"), (203, "same words again " * 40), (None, text(50))]
    labels = [(i, 1) for i in range(30)] + [(130 + i, 0) for i in range(30)] + [(999, 1), (None, 0), (3, None), (131, 0), (5, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = corpus()
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.string()), "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64())}), f"{at}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int64()), "toxic": pa.array([0] * len(labels), pa.int64())}), f"{at}/labels.parquet")
    return at


def test_stages_keep_clean_documents_and_white_space(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    texts = dict(corpus()[0])
    kept = corpus_pipeline.quality_stage(spark, docs, at)
    assert kept.columns == COLUMNS
    first = {r.doc_id: r.text for r in kept.collect()}
    assert all(i in first for i in range(40)) and not any(i in first for i in (*range(130, 160), 200, 201, 202, 203))
    one = corpus_pipeline.near_dedup_stage(spark, kept, at)
    second = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == COLUMNS and set(second) <= set(first)
    for i in range(5):
        assert (i in second) + (100 + i in second) == 1 and (i + 5 in second) + (115 + i in second) == 1
    assert all(i in second for i in range(10, 40)) and all(120 + i in second for i in range(4))
    cut = corpus_pipeline.substring_dedup_stage(spark, one, at)
    third = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == COLUMNS and set(third) == set(second)
    for i in range(4):
        t = texts[120 + i]
        words = t.split()
        assert third[120 + i].text.startswith(f"def f{i}():\n\tx = 1\n\n") and third[120 + i].text.endswith("\n")
        assert third[120 + i].text.split() == words[: 5 + 80] + words[5 + 80 + 60 :] and third[120 + i].n_chars == len(third[120 + i].text)
    assert all(third[i].text == second[i] for i in second if i is None or i < 120 or i >= 200)


def test_run_packs_what_the_stages_keep(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        assert r.offset == 0 and r.length & (r.length - 1) == 0
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = collections.Counter((k, tuple(x for _, ids in sorted(v) for x in ids)) for k, v in pieces.items())
    assert got == want


def test_stages_on_empty_tables(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_fit_on_repeats_nulls_and_no_labels(spark, at):
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rules = fit(docs, labels)
    assert rules.rules and fit(docs.unionByName(docs), labels.unionByName(labels)) == rules
    for none in (labels.where("false"), labels.where("quality IS NULL"), labels.where("doc_id = 999"), labels.where("quality = 1 AND doc_id < 30")):
        assert fit(docs, none) == DecisionList()
    assert fit(docs.where("false"), labels) == DecisionList()
    assert apply_rules(docs.where("false"), rules).count() == keep_good(docs.where("false"), rules).count() == 0
    assert fit(docs, labels, max_labelled=1) == DecisionList()


def test_queries_carry_ids_and_digests(spark, at):
    texts = dict(corpus()[0])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    got = {r.doc_id: r for r in queries.op1_token_store(spark, at).collect()}
    for key in sorted(texts, key=lambda k: (k is not None, k or 0)):
        ids = [*t.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in queries.op9_near_dup(spark, at).collect():
        assert r.class_size == 1 or r.doc_id is not None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_near_duplicates_recall(spark):
    """Every pair of 0.8 or more is in one class, and only such links join classes, on the driver's 200 smallest documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter() for _, w in rows]
    df = collections.Counter(g for c in grams for g in c)
    weights = [{g: n * (1 + 0.25 * math.log(len(rows) / df[g]) / math.log(len(rows))) for g, n in c.items()} for c in grams]
    total, by = [sum(w.values()) for w in weights], collections.defaultdict(list)
    for i, w in enumerate(weights):
        for g in w:
            by[g].append(i)
    both = collections.Counter()
    for g, at in by.items():
        for a in range(len(at)):
            for b in range(a):
                both[at[b], at[a]] += min(weights[at[a]][g], weights[at[b]][g])
    links = [(i, j) for (i, j), s in both.items() if s >= 0.8 * (total[i] + total[j] - s)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    got = {r.doc_id: r.class_uid for r in near_duplicates(docs).collect()}
    assert links and all(got[rows[i][0]] == got[rows[j][0]] for i, j in links)  # a recall of 1
    assert len(set(got.values())) == len({find(i) for i in range(len(rows))})
