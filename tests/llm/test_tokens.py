"""Encoders against the libraries, segments, automaton and cuts against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm.byte_bpe import bpe_decode, bpe_encode, matrix_encoder, read_ranks
from tidemark.llm.packing import cuts, pack
from tidemark.llm.storage import scratch_path
from tidemark.llm.token_store import Segment, encode, read_tokens, write_tokens
from tidemark.llm import storage, units
from tidemark.llm.units import UnitEncoder, library_encoder
from tidemark.llm.wordpiece import Automaton, token_counts

ODD = ["", " ", "a  b", "a\n\nb", "a \n b", "\n", "\t\tx", " lead", "trail  ", "a\n\n\n", "it's 's 'll", "é é ́x", "日本語 テスト\n次", "a" * 3000, "\r\nf\r\n b", "<|endoftext|> a", "3\x1c4 \x1c5", "İ ΑΣ Σ", " " * 700 + "x", "z" + "\n" * 300]
rng = random.Random(1)
ODD += ["".join(rng.choice(" \n\t aab's1é. \x1c日") for _ in range(rng.randint(1, 40))) for _ in range(800)]


ADDED = ["Hello <|endoftext|> x", "a  <|endoftext|>  b\n<|startoftext|>\nc", "<|ENDOFTEXT|>\n<|endoftext|>", "x<|endoftext|><|endoftext|>", "\x01 a\x01b \x01", "a < b <|", None]
ADDED += ["a.b (c) d!'s e'f-g", "don't.x'll", "<|endoftext", "x|y<|startoftext|>z.w"]
ADDED += ["".join(rng.choice([" ", "\n", "  ", "a", "<|endoftext|>", "b's", "\x85", "<", ".", "!'s", "'re", "(", "1", "=\u0338", "e\u0301"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]


def encoded(encoder, texts, group):
    out = []
    for lo, hi, ids, bounds in encoder.documents(pa.array(texts), group):
        assert lo == len(out)
        out += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
    assert len(out) == len(texts)
    return out


@pytest.mark.parametrize("group", [1 << 20, 50, 7])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_whole_texts(name, group):
    t = Tokenizer.from_file(P.path(name))
    texts = [*ODD, *ADDED, " ".join(ODD) * 3]
    for text, ids in zip(texts, encoded(library_encoder(P.path(name)), texts, group), strict=True):
        assert ids == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_cache_of_units_drops_and_keeps():
    calls = []

    def encode(units):
        calls.extend(units)
        return [np.array([len(u)], "<u4").tobytes() for u in units]

    e = UnitEncoder(encode)
    texts = [f"a w{i}{'x' * (i % 50)}" for i in range(2000)]
    old, units.CACHE_UNITS = units.CACHE_UNITS, 100
    try:
        assert encoded(e, texts, 100) == [[1, len(t) - 1] for t in texts]
    finally:
        units.CACHE_UNITS = old
    assert calls.count(b"a") == 1 and len(e._young) + len(e._old) < 200


@pytest.mark.parametrize("group", [1 << 20, 64])
def test_matrix_bpe_equals_tiktoken(group):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    texts = [*ODD, *ADDED, "ab" * 700, "q" * 5000 + "xyz" * 300]
    for text, ids in zip(texts, encoded(matrix_encoder(path, P.PATTERN), texts, group), strict=True):
        assert ids == t.encode_ordinary(text or ""), repr(text)[:80]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 60000, 2**32])
def test_segment_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    s = Segment(encode(ids))
    assert (s.read() == ids).all()
    if s.blocks > 3:
        assert (s.read(1, 3) == ids[128:384]).all()


def test_automaton_equals_greedy_longest_match():
    for vocabulary in ([b"a", b"b", b"ab", b"abcdx", b"c", b"bcd", b"cdy", b"d"], [b"aa", b"aab", b"b"]):
        a, known = Automaton(vocabulary), set(vocabulary)

        def brute(w):
            n = i = 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in known), None)
                if j is None:
                    return 1
                i, n = j, n + 1
            return n

        for _ in range(2000):
            w = bytes(rng.choice(b"abcdxy") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == brute(w), w


def test_cuts_are_powers_of_two():
    n = np.arange(1, 9000, 7)
    owner, length = cuts(n)
    assert (np.bincount(owner, length) == n).all() and (length & (length - 1) == 0).all() and length.max() == 4096
    assert (np.diff(length)[np.diff(owner) == 0] <= 0).all()
    owner, length = cuts([0, 3, 2], 1)
    assert owner.tolist() == [1, 1, 1, 2, 2] and set(length.tolist()) == {1}
    assert cuts([], 8)[0].tolist() == []


def test_store_pack_count_encode_on_nulls_ties_and_clashes(spark):
    rows = [(2, "b b", 1), (1, None, 1), (None, "x", 1), (2, "b b", 1), (3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    path = scratch_path(spark, "test-store")
    tokenizer = P.path("byte_bpe_50k.json")
    write_tokens(docs, tokenizer, 0, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, bytes(r.ids)) for r in read_tokens(spark, path).collect())
    assert [g[1] for g in got] == [0, 1, 2, 2, 3]
    assert [g[2] for g in got] == [0, *np.cumsum([g[3] for g in got])[:-1]]
    assert got[1][4] == b"\0\0\0\0" and got[2][4] == got[3][4]
    write_tokens(docs.where("false"), tokenizer, 0, empty := scratch_path(spark, "test-empty"))
    assert read_tokens(spark, empty).count() == 0
    packed = pack(docs, P.path("word_bpe_49k.json"), 2).collect()
    assert pack(docs.where("false"), P.path("word_bpe_49k.json"), 2).count() == 0
    assert all(r.sequence_id >> 57 == r.bucket and 1 << r.bucket == r.length == len(r.ids) // 4 for r in packed)
    assert len({r.sequence_id for r in packed}) == len(packed) and {r.doc_tokens for r in packed if r.doc_id == 1} == {1}
    counted = token_counts(docs, P.path("byte_bpe_50k.tiktoken"))
    assert counted.columns.count("n_words") == 1 and {(r.doc_id, r.n_words) for r in counted.collect()} == {(2, 2), (1, 0), (None, 1), (3, 0)}
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe_decode(bpe_encode(docs, ranks, P.PATTERN), ranks).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"b b", b"b b", b"x"]
    assert zlib.crc32(got[2][4]) == zlib.crc32(got[3][4])
    odd = spark.createDataFrame([(1, [0, 1], "own"), (2, None, "x"), (3, [], None)], "id int, token_ids array<int>, decoded string")
    first = {v: k for k, v in read_ranks(ranks).items()}
    assert {r.id: r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe_decode(odd, ranks).collect()} == {1: first[0] + first[1], 2: None, 3: b""}
    assert bpe_decode(odd.where("false"), ranks).count() == bpe_encode(docs.where("false"), ranks, P.PATTERN).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        bpe_decode(odd.selectExpr("id", "array(60000) AS token_ids"), ranks).collect()
    clash = spark.createDataFrame([(1, "a b", [5], "z")], "doc_id long, text string, token_ids array<int>, decoded string")
    assert bpe_decode(bpe_encode(clash, ranks, P.PATTERN), ranks).columns == ["doc_id", "token_ids", "decoded"]


def test_units_that_open_with_a_space_go_without_signs():
    name = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(name)
    opens = units._space_tokens(name)
    assert [bool(opens[i]) for i in (t.token_to_id("\u0120the"), t.token_to_id("the"), t.token_to_id("\u0120"))] == [True, False, True]
    assert units._space_tokens(P.path("word_bpe_49k.json")) is None
    some = list(dict.fromkeys([" don't", " 'tis", " x'll've", " \xe9\xe9", " 1a2", " ...", " \u0301", " \u65e5", "x", "'s", " ", "\n", "", " a\nb", "<|endoftext|>", " <", *(" " + "".join(rng.choice("ab's1\xe9.\u65e5-") for _ in range(rng.randint(1, 9))) for _ in range(2000))]))
    got = units.library_encoder(name)._encode([x.encode() for x in some])
    for x, ids in zip(some, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_a_worker_drops_its_units_when_other_work_comes():
    storage.serve("packing")
    first = library_encoder(P.path("byte_bpe_50k.json"))
    storage.serve("packing")
    assert library_encoder(P.path("byte_bpe_50k.json")) is first
    storage.serve("near_dup")
    assert not units._library
    assert encoded(library_encoder(P.path("byte_bpe_50k.json")), ["a b"], 50) == encoded(first, ["a b"], 50)
