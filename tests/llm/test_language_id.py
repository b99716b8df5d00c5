"""Language identification: automata, parses against a plain version, held-out accuracy."""

import math
import random
import zlib

import numpy as np

from tidemark.llm import language_id as li
from tidemark.llm.language_id import Parser, automaton, fit, held_out, identify, learn, letters, transitions

SAMPLES = {"aa": "the cat sat on the mat and the rat", "bb": "le chat était sur le tapis où l été", "cc": "日本 語 の 文章"}


def model(samples=SAMPLES):
    return learn({k: (len(v), transitions(v)) for k, v in samples.items()})


def parse(text, sample, segment):
    """Phrases by searching the sample."""
    n = 0
    for lo in range(0, len(text), segment):
        part, i = text[lo : lo + segment], 0
        while i < len(part):
            m = 1
            while i + m <= len(part) and part[i : i + m] in sample:
                m += 1
            i += max(m - 1, 1)
            n += 1
    return n


def test_an_automaton_knows_every_substring_and_no_other_text():
    r = random.Random(1)
    text = "".join(r.choice("abc") for _ in range(60))
    step = automaton(text)

    def known(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    assert all(known(text[i:j]) for i in range(60) for j in range(i, 61))
    for _ in range(500):
        s = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        assert known(s) == (s in text)
    assert len(step) <= 2 * len(text)


def test_phrases_equal_a_plain_parse():
    r = random.Random(2)
    m = model()
    parser = Parser(m)
    texts = ["  ,", " a ", "The CAT sat, on the mat!", "x", "été où 1 2 3 le chat", "日本語の文章です", "", None, "...", "été" + "ß" * 5, "the cat " * 1000]
    texts += ["".join(r.choice("thecatso é日ß,.") for _ in range(r.randint(1, 3000))) for _ in range(30)]
    names, scores = parser.languages(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        clean = letters(text or "")
        if not any(c.isalpha() for c in clean):
            assert (name, score) == ("und", 0.0)
            continue
        bits = [parse(clean, SAMPLES[k], li.SEGMENT) * math.log2(len(SAMPLES[k])) for k in m.languages]
        best = min(range(len(bits)), key=lambda i: (round(bits[i], 9), i))
        assert abs(bits[m.languages.index(name)] - bits[best]) < 1e-9
        assert abs(score - 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits)) < 1e-9


def test_a_text_above_the_step_is_parsed_whole(monkeypatch):
    parser = Parser(model())
    long = "the cat sat on le tapis " * 2000
    want = parser.languages([long, "le chat"])
    monkeypatch.setattr(li, "STEP", 8 * li.SEGMENT)
    assert parser.languages([long, "le chat"]) == want
    assert parser.languages(["le chat", long, None])[0][1] == want[0][0]


def test_identify_handles_nulls_empty_tables_and_columns_of_the_same_name(spark):
    schema = "doc_id long, text string, score string, state int"
    docs = spark.createDataFrame([(1, "the cat sat", "s", 1), (None, None, None, None), (2, "", "s", 1), (2, "12 34 !", "s", 1), (3, "le chat était", "s", 1), (3, "le chat était", "s", 1)], schema)
    got = identify(docs, model())
    assert got.columns == ["doc_id", "state", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got.collect()) == [(0, "und"), (1, "aa"), (2, "und"), (2, "und"), (3, "bb"), (3, "bb")]
    assert identify(docs.limit(0), model()).count() == 0
    nothing = fit(spark.createDataFrame([("a text", None), (None, "en")], "text string, lang string"))
    assert nothing.languages == () and {(r.lang_pred, r.score) for r in identify(docs, nothing).collect()} == {("und", 0.0)}


def test_held_out_documents_teach_nothing_and_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for r in docs.select("doc_id", held_out("doc_id").alias("h")).limit(50).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    learned = fit(docs.where(~held_out("doc_id")))
    again = fit(docs.where(~held_out("doc_id")).repartition(7))
    assert learned.languages == again.languages == ("de", "en", "es", "fr") and np.array_equal(learned.edges, again.edges)
    assert all(c <= li.MAX_CHARS for c in learned.chars)
    rows = identify(docs.where(held_out("doc_id")), learned).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right >= 0.98 * len(rows), (right, len(rows))
    assert all(0 <= r.score <= 1 for r in rows)
