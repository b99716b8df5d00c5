"""Substring, suffix and near dedup, top-k and extraction against brute force on small fixtures."""

import collections
import math
import random
import time
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import cover_tree, hashing, html_main_text, near_dup
from tidemark.llm import hashing as H
from tidemark.llm import suffix_dedup as suffix
from tidemark.llm.blocks import Order
from tidemark.llm.cells import common
from tidemark.llm.cover_tree import Search, top_k
from tidemark.llm.html_main_text import extract, main_text
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.quality_rules import DecisionList, apply_rules, keep_good, learn
from tidemark.llm.substring_dedup import _without, substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.weighted_minhash import can_link, similarity

SCHEMA = "doc_id long, text string, block long, n_removed int"


def corpus(seed, n=60, words=90):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, words))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = shared
        if i % 10 == 0 and out:
            w = out[-1][1].split(" ")[:]
            w[len(w) // 2] = "changed"
        out.append((i, r.choice([" ", "\n"]).join(w) if i % 7 else " ".join(w), 1, 2))
    return out + [(100, None, 1, 2), (101, "", 1, 2), (102, " \t\n", 1, 2), (0, out[0][1], 1, 2), (None, out[5][1], 1, 2), (103, "word " * 3000, 1, 2)]


def test_substring_dedup_equals_brute_force(spark):
    rows, k = corpus(1), 35
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    seen = collections.Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    want = collections.Counter()
    for (key, raw, *_), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        want[key, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), None if gone else raw] += 1
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), "text", k)
    assert got.columns == ["doc_id", "text", "block", "n_words", "n_removed"]
    # White space stays: a text that loses nothing is as before, and between kept words stands what stood there.
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode(), None if r.n_removed else r.text) for r in got.collect()) == want
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_keeps_line_ends_and_indentation():
    cut = lambda text, gone: _without(text.encode(), np.array([c == "x" for c in gone])).decode()
    assert cut("  a\n\tb  c\nd ", ".xx.") == "  a\n\td "
    assert cut("a b\n\nc\n", "..x") == "a b\n\n\n"
    assert cut("a b", "xx") == "" and cut("é\nb\tc", "x.x") == "b\t"


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_hashes_do_not_depend_on_steps(monkeypatch, step):
    monkeypatch.setattr(hashing, "STEP", step)
    text = np.frombuffer(b"aa bb aa bb aa  longer-word-than-a-step aa bb" * 3, np.uint8)
    start, end, _ = hashing.words(text, np.array([0, len(text)]))
    words = [bytes(text[a:z]) for a, z in zip(start, end, strict=True)]
    h = hashing.word_hashes(text, start, end)
    assert len({(w, int(x)) for w, x in zip(words, h, strict=True)}) == len(set(words)) == len(set(h.tolist()))
    at = np.arange(len(text) - 4)
    r = hashing.rolling(text, at, 5, hashing.BYTE_BASE)
    assert len({(bytes(text[i : i + 5]), int(x)) for i, x in zip(at, r, strict=True)}) == len(set(r.tolist())) == len({bytes(text[i : i + 5]) for i in at})


def test_cover_positions():
    offsets = np.cumsum([0, 5, 300, 0, 68, 67, 1000])
    for depth in (1, 68):
        want = [a + i for a, z in zip(offsets, offsets[1:]) for i in range(z - a) if i % suffix.PERIOD in suffix.COVER and z - a - i >= depth]
        assert suffix._cover(offsets, depth).tolist() == want


def test_suffix_dedup_equals_brute_force(spark):
    rows, k = corpus(2), 200
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(w[i : i + k] for w in texts for i in range(len(w) - k + 1))
    want = collections.Counter()
    for (key, *_), w in zip(rows, texts, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if seen[w[i : i + k]] > 1:
                gone[i : i + k] = True
        want[key, len(w), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(b for b, g in zip(w, gone, strict=True) if not g)] += 1
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(3, 50) + [(200 + i, " ".join(f"base{j}" if j != 7 * i else "edit" for j in range(120)), 1, 2) for i in range(1, 12)]
    terms = []
    for _, t, *_ in rows:
        w = (t or "").split()
        terms.append(collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    df, n = collections.Counter(x for c in terms for x in c), len(rows)
    weights = [{x: c * (1 + 0.25 * math.log(n / df[x]) / math.log(n)) for x, c in t.items()} for t in terms]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = sum(min(weights[i][x], weights[j][x]) for x in weights[i].keys() & weights[j].keys())
            total = sum(weights[i].values()) + sum(weights[j].values()) - both
            if total and both / total >= 0.8:
                root[find(i)] = find(j)
    docs = spark.createDataFrame([(i, r[1], 5) for i, r in enumerate(rows)], "i long, text string, keeps int").repartition(3)
    got = near_duplicates(docs).collect()
    classes = {r.i: r.class_uid for r in got}
    for i in range(n):
        for j in range(i):
            assert (classes[i] == classes[j]) == (find(i) == find(j)), (rows[i], rows[j])
    assert sum(r.keeps for r in got) == len(set(classes.values()))


def exact_top(data, ids, queries, rows, k=20):
    for q, row in zip(queries, rows, strict=True):
        scores = data @ q
        yield sorted((x for x in range(len(data)) if x != row), key=lambda x: (-scores[x], ids[x], x))[:k]


@pytest.mark.parametrize("spread", [0, 3, 1000])
def test_cover_tree_search_is_exact(spread):
    r = np.random.default_rng(spread)
    data = r.integers(-spread, spread + 1, (900, 6)) + 20 * r.integers(0, 3, (900, 1))
    rows, ids = np.arange(0, 900, 20), r.permutation(900) // 2
    s = Search(np.arange(900), ids, data, 20)
    _, found = s.run(rows, data[rows])
    assert [f.tolist() for f in found] == list(exact_top(data, ids, data[rows], rows))
    # Starting scores cut what is below them, not ties.
    kth = np.array([(data @ data[q])[f[4]] for q, f in zip(rows, found, strict=True)])
    scores, _ = s.run(rows, data[rows], kth)
    assert all(len(x) >= 5 and x[min(len(x), 20) - 1] >= t for x, t in zip(scores, kth, strict=True))


@pytest.mark.parametrize("apart", [0, 400])
def test_top_k_equals_brute_force_over_blocks(spark, monkeypatch, apart):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 60)
    monkeypatch.setattr(cover_tree, "GROUP_ROWS", 7)
    monkeypatch.setattr(cover_tree, "GROUPS", 3)
    r = np.random.default_rng(apart)
    data = r.integers(-60, 61, (1500, 5)) + apart * r.integers(-1, 2, (1500, 5))
    data[::7] = data[3]
    ids = [int(x) if x % 31 else None for x in r.permutation(1500)]
    rows = [(i, [float(y) / 64 for y in x], "own") for i, x in zip(ids, data, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string").repartition(3)
    tie = np.array([2**60 if i is None else i for i in ids])
    asks = [x for x in range(1500) if ids[x] is not None and ids[x] % 20 == 0]
    want = {(ids[x], n): (ids[y], int(data[x] @ data[y])) for x, top in zip(asks, exact_top(data, tie, data[asks], asks), strict=True) for n, y in enumerate(top, 1)}
    got = top_k(df, df.vec_id % 20 == 0).collect()
    assert len(got) == len(want) and {(g.query_id, g.rank): (g.vec_id, g.score) for g in got} == want


def test_cells_are_skipped_where_vectors_form_groups():
    r = np.random.default_rng(5)
    sample = (r.integers(-20, 21, (900, 8)) + 3000 * np.eye(8, dtype=int)[r.integers(0, 8, 900)]).astype(np.int64)
    m2 = float((sample.astype(float) ** 2).sum(axis=1).max())
    p = cover_tree.Pivots(sample, m2, 8)
    norms = (sample.astype(float) ** 2).sum(axis=1)
    cell, far = p.nearest(sample, np.sqrt(m2 - norms))
    qcell, near = p.nearest(sample, np.zeros(900))
    size = range(len(p.centers))
    p.data_rows, p.data_radius = np.bincount(cell, minlength=len(size)), np.array([far[cell == c].max(initial=0) for c in size])
    p.asks_rows, p.asks_radius, p.top = np.bincount(qcell, minlength=len(size)), np.array([near[qcell == c].max(initial=0) for c in size]), np.array([norms[qcell == c].max(initial=0) for c in size])
    opened = 0
    for c in np.flatnonzero(p.asks_rows):
        scores = sample[qcell == c] @ sample.T
        worst = np.sort(scores, axis=1)[:, -21].min()
        may = p.open(c, worst)
        assert set(cell[(scores >= worst).any(axis=0)]) <= set(may)
        opened += len(may)
    assert opened <= len(np.flatnonzero(p.asks_rows)) * (p.data_rows > 0).sum() / 2


def test_top_k_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (20, [1.0, 2.0]), (None, [0.5, 0.5]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, df.vec_id % 20 == 0).collect()
    rest = [(2, 1, 6144), (3, None, 6144), (4, 6, 4096), (5, 7, 0)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(0, 1, 20, 20480), *((0, *x) for x in rest), (20, 1, 0, 20480), *((20, *x) for x in rest)]
    assert top_k(df.where("false"), df.vec_id % 20 == 0).count() == 0 and top_k(df, df.vec_id < 0).count() == 0


def test_top_k_is_exact_up_to_its_bound_and_says_where_it_is_not(spark):
    for large in (1e300, float(2**31), -float(2**31)):
        df = spark.createDataFrame([(1, [1.0, 2.0]), (20, [2.0, 1.0]), (33, [large, 2.0]), (40, [0.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="vec_id 33"):
            top_k(df, df.vec_id % 20 == 0)
    rows = [(i, [float((2**23 - i * 7) * (-1) ** i), float(i), 2.0**23 - i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    for r in top_k(df, df.vec_id % 20 == 0, 5).collect():
        best = sorted((-sum(a * b for a, b in zip(x[r.query_id], x[j], strict=True)), j) for j in x if j != r.query_id)
        assert (-r.score, r.vec_id) == best[r.rank - 1]


PAGE = """<html><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="wrap row12"><div class="content"><h1>T &amp; x</h1><p>one<b>two</b>
 three<p>four <a href=x>link</a><div class="ad-box">buy</div><ul><li>i1<li>i2</ul><form><p>mail</form><script>var a="</p>"</script></div><aside>side</aside>
<section class="comments"><p>nice post</p></section></div><footer>f</footer>"""


def test_extract_drops_what_is_not_the_article():
    assert extract(PAGE, None) == "T & x onetwo three four link i1 i2"
    for odd in ("", "<", "<<a>>", "<p", "</p>", "<!-- x", "<script>x", "<div>" * 3000 + "x"):
        assert isinstance(extract(odd, None), str)


ARTICLE = "The article that the page is about, with a few words more."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content with-sidebar'><p>{ARTICLE}</p></div><div>other box</div>", ARTICLE),
        (f"<form id='aspnetForm'><div><p>{ARTICLE}</p></div></form><p>tail</p>", ARTICLE),
        (f"<div class='share-price-news'><p>{ARTICLE}</p></div><div>side</div>", ARTICLE),
        (f"<p>{ARTICLE} <span class='ad'>BUY <span>NOW</span></span>end</p>", f"{ARTICLE} end"),
        (f"<div><p>{ARTICLE}</p><p style='display: none'>unseen</p><p hidden>unseen</p><div aria-hidden=true>x</div></div>", ARTICLE),
        (f"<article class='entry-post'><div class='entry-header'><h1>Head</h1></div><p>{ARTICLE}</p><article class='comment'>{ARTICLE * 3}</article></article>", f"Head {ARTICLE}"),
        (f"<div class='sidebar'><main><p>{ARTICLE}</p></main></div><div class='sidebar'>{ARTICLE[:20]}</div>", ARTICLE),
        (f"<div id=searchBox>find</div><div class='paywall'><p>{ARTICLE}</p></div><a class='ad'><div>buy</div></a><div class='site-header'>Site</div>", ARTICLE),
        (f"<p>{ARTICLE}<p>a <b", f"{ARTICLE} a <b"),
        ("<p>1 < 2 &lt;b&gt; &amp;amp; x&nbsp;y</p>", "1 < 2 <b> &amp; x y"),
    ],
)
def test_names_are_weighed(page, text):
    assert extract(page, None) == text


@pytest.mark.parametrize("piece", ["<a ", '<a "x ', "<a \"'> ", "<!-- ", "<button>", "<x-y>", "<p><table>", "<script", "</", "<li><p>", "<div class='" + "b" * 50 + "'>"])
def test_time_is_linear_in_the_page(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    extract(page, None)
    assert time.process_time() - began < 20


def test_pages_repeat_are_empty_and_have_clashing_columns(spark, monkeypatch):
    rows = [(1, "http://h.example/1", PAGE, "own", 5)] * 2 + [(None, None, PAGE, None, None), (2, "no host", "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    want = [("T & x onetwo three four link i1 i2", 34)] * 3 + [("", 0)]
    assert sorted((r.text, r.n_chars) for r in main_text(df).collect()) == sorted(want)
    monkeypatch.setattr(html_main_text, "BROADCAST_CHARS", 0)
    assert sorted((r.text, r.n_chars) for r in main_text(df).collect()) == sorted(want)
    assert main_text(df.where("false")).count() == 0


def test_main_text_follows_the_hosts_votes(spark):
    page = lambda main, side: f"<body><div class='x1'><p>{main}</p></div><div class='y'><p>{side}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page("long article text " * 9, "short")) for i in range(5)] + [(5, "http://h.example/5", page("tiny", "a much longer side box " * 9)), (6, None, None), (7, "http://k.example", "")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("long article") and "short" not in got[0]
    assert got[5] == "tiny" and got[6] == "" and got[7] == ""


def test_quality_statistics_equal_brute_force(spark):
    rows = corpus(4) + [(300, "a b c d e f g h i j " * 3, 1, 2), (301, "x\nx\n\n\nx\r\n #$%", 1, 2)]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in apply_rules(spark.createDataFrame(rows, SCHEMA), DecisionList()).collect())
    want = collections.Counter()
    for key, t, *_ in rows:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[key, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    assert got == want


def test_learned_list_separates_held_out_rows(spark):
    r = random.Random(5)
    row = lambda bad: {f: r.random() for f in ("chars_per_word", "dup_lines_per_100_words", "repeat_percent", "distinct_percent", "shouts_per_100_words")} | {"symbols_per_100_words": r.uniform(20, 90) if bad and r.random() < 0.5 else r.uniform(0, 5), "capitals_percent": 0.0, "bad": bad, "prune": r.random() < 0.33}
    rows = [row(i % 4 == 0) for i in range(600)]
    for x in rows:
        if x["bad"] and x["symbols_per_100_words"] < 20:
            x["capitals_percent"] = r.uniform(40, 90)
    rules = learn(rows)
    assert 1 <= len(rules.rules) <= 4
    fresh = [row(False) for _ in range(200)]
    assert not any(all(c.holds(x) for c in rule) for x in fresh for rule in rules.rules)
    docs = spark.createDataFrame([(1, "good words here " * 5 + "one two three four five six", 0), (2, "few words", 0), (3, None, 0)], "doc_id long, text string, kept int")
    kept = keep_good(docs, rules).collect()
    assert all(r.doc_id == 1 for r in kept)


@pytest.mark.parametrize("n,v", [(1, 4), (40, 30), (60, 900), (150, 2500)])
def test_cell_compares_all_pairs(n, v):
    r = np.random.default_rng(n)
    vectors = []
    for _ in range(n):
        k = r.integers(0, min(v, 200))
        vectors.append((np.sort(r.choice(v, k, replace=False)).astype(np.uint64), r.integers(1, 5, k) * 1.25))
    left, right = np.flatnonzero(r.random(n) < 0.7), np.flatnonzero(r.random(n) < 0.7)
    got = common(vectors, left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            x, y = (dict(zip(*(z.tolist() for z in vectors[c]), strict=True)) for c in (a, b))
            assert a == b or abs(got[i, j] - sum(min(x[t], y[t]) for t in x.keys() & y.keys())) < 1e-9


def test_near_duplicates_of_one_key_over_many_cells(spark, monkeypatch):
    """Six texts of a group sit near one another, the groups just under the threshold: a leader finds its own only."""
    monkeypatch.setattr(near_dup, "CELL_TEXTS", 3)
    r = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for g in range(6):
        text = list(base)
        for at in r.sample(range(80), 9):
            text[5 * at] = f"g{g}-{at}"
        for k in range(6):
            copy = list(text)
            copy[5 * (20 + k)] += f"x{k}"
            rows.append((6 * g + k, " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    df = collections.Counter(x for s in sets for x in s)
    weight = {x: 1 + 0.25 * np.log(len(rows) / n) / np.log(len(rows)) for x, n in df.items()}
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both, either = (sum(weight[x] for x in s) for s in (sets[i] & sets[j], sets[i] | sets[j]))
            if both / either >= 0.8:
                root[find(i)] = find(j)
    got = {x.i: x.class_uid for x in near_duplicates(spark.createDataFrame(rows, "i long, text string").repartition(3)).collect()}
    assert len({find(i) for i in range(len(rows))}) > 1
    assert all((got[i] == got[j]) == (find(i) == find(j)) for i in range(len(rows)) for j in range(i))


@pytest.mark.parametrize("bits", [40, 64])
def test_order_of_a_block_takes_few_arrays(bits):
    r = np.random.default_rng(bits)
    n, buckets = 200_000, 51
    h1, h2 = (H.mix(r.integers(0, n // 2, n).astype(np.uint64) + np.uint64(x << 20)) for x in (1, 2))
    tracemalloc.start()
    order = Order(h1, h2, buckets, bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * n
    keys = np.stack([(h2 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), h1 >> np.uint64(64 - bits)])
    want, rank, counts = np.unique(keys, axis=1, return_inverse=True, return_counts=True)
    assert (order.values == want[1]).all() and (order.rank == rank.ravel()).all() and (order.counts == counts).all()
    assert (order.starts == np.searchsorted(want[0], np.arange(buckets + 1))).all()


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_texts_without_bands_have_no_partner(threshold):
    r = np.random.default_rng(5)
    docs = [np.sort(r.choice(400, r.integers(1, 12), replace=False)) for _ in range(300)]
    docs += [np.unique(np.append(d[: len(d) - i % 3], 1000 + i)) for i, d in enumerate(docs[:60])]  # near copies with a word of their own
    docs += [np.arange(5000 + 9 * i, 5009 + 9 * i) for i in range(40)]  # nothing shared
    terms, starts = np.concatenate(docs), np.cumsum([0, *map(len, docs)])[:-1]
    weights = r.integers(1, 4, len(terms)).astype(float)
    df = np.bincount(terms)[terms]
    able = can_link(weights, df > 1, starts, threshold)
    vectors = [(terms[a:z].astype(np.uint64), weights[a:z]) for a, z in zip(starts, [*starts[1:], len(terms)], strict=True)]
    linked = set()
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if similarity((*a, a[1].sum()), (*b, b[1].sum())) >= threshold:
                linked |= {i, j}
    assert linked and able[list(linked)].all()
    assert not able[-40:].any()
