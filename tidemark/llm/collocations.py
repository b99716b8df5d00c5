"""Collocations: phrases whose words stand together more often than their parts explain, found by hashed passes.

A pass over the texts counts the phrases of one length exactly and, in the same reading,
counts hash buckets of the next length (PCY, DHP). The next pass counts a phrase only
where its bucket reached the least frequency and both phrases one word shorter may be
frequent (Apriori): both tests are bits of broadcast bitmaps of fixed size. Hashes only
decide what is counted: a bit may be set in vain, never be missing, and counts go by the
phrases themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix, word_hashes
from tidemark.llm.storage import give_back, map_arrow, partitions, written

#: What cuts pieces, what separates words inside one, and the language of none.
CUTS, SPACES, NO_LANGUAGE = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09", "und"
LONGEST = 4
#: Bytes of text that are taken apart at once, and the words of a cut-off piece that are seen again with what follows.
STEP, OVERLAP = 4 << 20, LONGEST - 1
#: Buckets: a quarter of the bytes of text, between these powers of two (the bitmaps have a bit for each, 64 MB at most).
LEAST_BITS, MOST_BITS = 16, 29
PAGE = 1 << 16
#: Rows of counts, and buckets, that a task holds before it merges or sends them.
HELD_ROWS, HELD_BUCKETS = 300_000, 6_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(CUTS)] = 1, 2
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_OUT = "lang binary, phrase binary, bucket long, n long, page int, places binary, counts binary"
_ARROW = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("bucket", pa.int64()), ("n", pa.int64()), ("page", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


class Words:
    """The words of some texts: their numbers in a dictionary of this batch, and where a piece begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, old: int = 0):
        """langs: a number for each text; old: so many first words were counted before."""
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        # A word that runs on over the end of its text is two.
        cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        start, end = (np.sort(np.concatenate([x, cut])) if len(cut) else x for x in (edge[0::2], edge[1::2]))
        n = len(start)
        by_text = np.searchsorted(start, offsets)
        self.opens = np.zeros(n + 1, bool)
        self.opens[np.searchsorted(start, np.flatnonzero(kind == 2))] = True
        self.opens[by_text] = True
        self.lang = np.repeat(langs, np.diff(by_text))
        bounds = np.concatenate([[0], np.cumsum(end - start)])
        raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[inside]])])
        coded = raw.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary
        self.old = old
        self.n = n

    def whole(self, k: int) -> np.ndarray:
        """Whether k words stand in one piece from each word on."""
        m = max(self.n - k + 1, 0)
        ok = np.ones(m, bool)
        for j in range(1, k):
            ok &= ~self.opens[j : j + m]
        return ok

    def fresh(self, at: np.ndarray, k: int) -> np.ndarray:
        """Those of the phrases of k words at `at` whose last word was not counted before."""
        return at[at + k > self.old]


def binary_hashes(values: pa.Array) -> np.ndarray:
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return word_hashes(data, bounds[:-1], bounds[1:])


def buckets_of(words: list[np.ndarray], lang: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of phrases from the hashes of their words, in order, and of their language."""
    h = lang + np.uint64(len(words))
    for f, w in zip(_FACTORS, words, strict=False):
        h = h + w * f
    return mix(h) >> np.uint64(64 - bits)


def bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """The words of (text, lang) rows in batches of some MB, with the languages that their numbers mean. A longer text comes in slices: each begins again with the last words of a piece that the one before cut off."""
    for batch in batches:
        coded = pc.fill_null(batch.column(1).cast(pa.large_binary()), pa.scalar(NO_LANGUAGE.encode(), pa.large_binary())).dictionary_encode()
        langs = coded.indices.to_numpy()
        column = pc.fill_null(batch.column(0).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1, lo + 1)
            part = data[offsets[lo] : offsets[hi]]
            if len(part) <= STEP:
                yield Words(part, offsets[lo : hi + 1] - offsets[lo], langs[lo:hi]), coded.dictionary
            else:
                for text, old in slices(part, STEP):
                    yield Words(text, np.array([0, len(text)]), langs[lo:hi], old), coded.dictionary
            lo = hi


def slices(text: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, int]]:
    """A text in slices that end where a word ends, and how many first words of each were in the one before."""
    begin, fresh, size = 0, 0, len(text)  # the slice begins at begin; words from fresh on are new
    while fresh < size:
        stop = min(fresh + step, size)
        while stop < size and _KIND[text[stop]] == 0:  # a word is never cut
            gap = np.flatnonzero(_KIND[text[stop : stop + step]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + step, size)
        yield text[begin:stop], len(_word_starts(text[begin:fresh]))
        piece = np.flatnonzero(_KIND[text[begin:stop]] == 2)
        last = begin + int(piece[-1]) + 1 if len(piece) else begin
        starts = _word_starts(text[last:stop])
        begin = last + int(starts[-OVERLAP]) if len(starts) > OVERLAP else last
        fresh = stop


def _word_starts(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(_KIND[text] == 0, prepend=False).astype(bool) & (_KIND[text] == 0))


class Counts:
    """Exact counts of phrases and sparse counts of buckets, merged as they grow."""

    def __init__(self, least: int):
        self._tables: list[pa.Table] = []
        self._rows = 0
        self._buckets: list[np.ndarray] = []
        self._held = 0
        self._least = least

    def phrases(self, words: Words, at: np.ndarray, k: int, langs: pa.Array, lang_hashes: np.ndarray, word_hash: np.ndarray, bits: int) -> None:
        """Count the phrases of k words that start at `at`: a phrase is a number from its first words' number and its last word's, so equal numbers are equal words."""
        if not len(at):
            return
        levels = []
        code = words.lang[at].astype(np.int64)
        for j in range(k):
            coded = pa.array((code << 32) | words.ids[at + j]).dictionary_encode()
            levels.append(coded.dictionary.to_numpy())
            code = coded.indices.to_numpy().astype(np.int64)
        n = np.bincount(code, minlength=len(levels[-1]))
        parts, up = [], np.arange(len(levels[-1]))
        for level in reversed(levels):
            pair = level[up]
            parts.append(pair & 0xFFFFFFFF)
            up = pair >> 32
        ids = parts[::-1]
        columns = [words.dictionary.take(pa.array(i)) for i in ids]
        phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
        bucket = buckets_of([word_hash[i] for i in ids], lang_hashes[up], bits)
        self._add(pa.table({"lang": langs.take(pa.array(up)), "phrase": phrase, "bucket": pa.array(bucket.astype(np.int64)), "n": pa.array(n.astype(np.int64))}))

    def _add(self, table: pa.Table) -> None:
        self._tables.append(table)
        self._rows += table.num_rows

    def buckets(self, at: np.ndarray) -> None:
        self._buckets.append(at.astype(np.uint32))
        self._held += len(at)

    def full(self) -> Iterator[pa.RecordBatch]:
        """What is to be sent so that memory stays bounded."""
        if self._rows > HELD_ROWS:
            merged = pa.concat_tables(self._tables).group_by(["lang", "phrase", "bucket"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "bucket", "n"])
            self._tables, self._rows = [merged], merged.num_rows
            if self._rows > HELD_ROWS // 2:
                yield from self._sent()
        if self._held > HELD_BUCKETS:
            yield from self._pages()

    def _sent(self) -> Iterator[pa.RecordBatch]:
        for table in self._tables:
            for b in table.to_batches(max_chunksize=50_000):
                none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.binary()), b.column("phrase").cast(pa.binary()), b.column("bucket"), b.column("n"), *none], schema=_ARROW)
        self._tables, self._rows = [], 0

    def _pages(self) -> Iterator[pa.RecordBatch]:
        """The counts of buckets (no higher than needed), a row for each page of them."""
        if self._held:
            x = np.sort(np.concatenate(self._buckets))
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, n = x[first], np.minimum(np.diff(first, append=len(x)), self._least).astype(np.uint32)
            page = x // PAGE
            edge = np.concatenate([np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])), [len(x)]])
            width = np.uint8 if self._least < 256 else np.uint32
            place, n = (x % PAGE).astype(np.uint16), n.astype(width)
            for lo in range(0, len(edge) - 1, 4096):
                some = list(zip(edge[lo : lo + 4096], edge[lo + 1 : lo + 4097], strict=False))
                rows = [pa.array([int(page[a]) for a, _ in some], pa.int32()), pa.array([place[a:b].tobytes() for a, b in some], pa.binary()), pa.array([n[a:b].tobytes() for a, b in some], pa.binary())]
                none = [pa.nulls(len(some), t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, *rows], schema=_ARROW)
        self._buckets, self._held = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._sent()
        yield from self._pages()


def _pass(docs: DataFrame, k: int, bits: int, least: int, hot, frequent) -> DataFrame:
    """Counts of phrases of k words, and of buckets of k + 1 words. hot, frequent: broadcast bitmaps, None in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, shorter = (np.frombuffer(b.value, np.uint8) if b is not None else None for b in (hot, frequent))
        counts = Counts(least)
        for words, langs in batches_of_words(batches):
            if not words.n:
                continue
            lang_hashes, by_word = binary_hashes(langs), binary_hashes(words.dictionary)
            hashes, lang = by_word[words.ids], lang_hashes[words.lang]
            at = np.flatnonzero(words.whole(k))
            if k > 1 and len(at):
                size = words.n - k + 2
                seen = bit(shorter, buckets_of([hashes[j : j + size] for j in range(k - 1)], lang[:size], bits))
                at = at[seen[at] & seen[at + 1]]
                at = at[bit(may, buckets_of([hashes[at + j] for j in range(k)], lang[at], bits))]
            counts.phrases(words, words.fresh(at, k), k, langs, lang_hashes, by_word, bits)
            if k < LONGEST:
                kept = np.zeros(words.n + 1, bool)
                kept[at] = True
                longer = np.flatnonzero(words.whole(k + 1))
                longer = words.fresh(longer[kept[longer] & kept[longer + 1]], k + 1)
                counts.buckets(buckets_of([hashes[longer + j] for j in range(k + 1)], lang[longer], bits))
            yield from counts.full()
        yield from counts.rest()
        give_back()

    return map_arrow(docs, run, _OUT).withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase")})


def _hot(counted: DataFrame, bits: int, least: int) -> bytes:
    """The bitmap of buckets counted `least` times or more. Pages are merged row by row, one dense page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint8 if least < 256 else np.uint32
        now, dense = -1, np.zeros(PAGE, np.uint32)

        def done() -> Iterator[pa.RecordBatch]:
            if now >= 0 and (dense >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(dense >= least, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

        for b in batches:
            for page, places, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if page != now:
                    yield from done()
                    now, dense[:] = page, 0
                at = np.frombuffer(places.as_buffer(), np.uint16)
                dense[at] = np.minimum(dense[at] + np.frombuffer(n.as_buffer(), width), least)
        yield from done()

    pages = counted.where("page IS NOT NULL").select("page", "places", "counts").repartition("page").sortWithinPartitions("page")
    return _bitmap(map_arrow(pages, run, "page int, bits binary").collect(), PAGE, bits)


def _bitmap(rows: list, page: int, bits: int) -> bytes:
    """As many bits as buckets, whatever the corpus."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    for number, part in rows:
        at = number * page // 8
        out[at : at + len(part)] = np.frombuffer(part, np.uint8)[: len(out) - at]
    return out.tobytes()


def _frequent_bits(frequent: DataFrame, bits: int) -> bytes:
    made = frequent.selectExpr("bucket + 1 AS b").groupBy(F.expr("bitmap_bucket_number(b) - 1").cast("int").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    return _bitmap(made.collect(), 1 << 15, bits)


def frequent_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the phrases of 1 to 4 words counted `least` times or more in their language, one for each length, and (lang, n) of all words. Null languages are `und`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size / 4, 1))), LEAST_BITS), MOST_BITS)
    found, words = [], None
    hot = frequent = None
    for k in range(1, LONGEST + 1):
        counted = written(_pass(rows, k, bits, least, hot, frequent), f"phrases-{k}")
        exact = counted.where("page IS NULL").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        if k == 1:
            words = counted.where("page IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        table = written(exact.where(F.col("n") >= least), f"frequent-{k}")
        found.append(table.select("lang", "phrase", "n"))
        for b in (hot, frequent):
            if b is not None:
                b.unpersist()
        if k < LONGEST:
            hot = spark.sparkContext.broadcast(_hot(counted, bits, least))
            frequent = spark.sparkContext.broadcast(_frequent_bits(table, bits))
    for b in (hot, frequent):
        b.unpersist()
    return found, words


def _with_part(cuts: DataFrame, parts: DataFrame, common: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of their `part` as `name`: of the common parts by broadcast, of the rest by a join in which no key has many rows."""
    known = lambda df: df.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    quick = cuts.join(F.broadcast(known(common)), ["lang", part], "left")
    rest = quick.where(F.col(name).isNull()).drop(name).join(known(parts), ["lang", part])
    return quick.where(F.col(name).isNotNull()).select(rest.columns).unionByName(rest)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered_percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases of 2 to 4 words, by score, a (both descending) and phrase.

    A-Z are lower-cased; texts are cut into pieces at CUTS and those into words at SPACES;
    counts are of one language. a: the phrase's occurrences, at least `least`; l and r: those
    of its two parts at the cut that gives the lowest score, floor(2000000 * a / (l + r)),
    ties to the smallest first part; n: all words of the language. A phrase inside a longer
    one that has covered_percent of its occurrences or more is left out. Null languages are
    `und`, null texts empty; an empty table gives no rows; other columns play no part.
    """
    found, words = frequent_phrases(docs, least, text, lang)
    total = words.agg(F.sum("n")).first()[0] or 0
    candidates = found[1].unionByName(found[2]).unionByName(found[3]).withColumnRenamed("n", "a")
    parts = found[0].unionByName(found[1]).unionByName(found[2])
    # A phrase of one length that a thousandth of all words begin: there are no more than 1,000 of each length.
    common = parts.where(F.col("n") * 1000 >= total)
    split = candidates.withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = split.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    scored = _with_part(_with_part(cuts, parts, common, "first", "l"), parts, common, "rest", "r")
    scored = scored.withColumn("score", F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = found[2].unionByName(found[3]).withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", "n", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("n").alias("above"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.expr(f"above IS NULL OR cast(above AS decimal(20, 0)) * 100 < cast(a AS decimal(20, 0)) * {covered_percent}")).drop("above")
    return _first(kept, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first rows with their rank: of ever fewer parts of it, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(partitions(rows.sparkSession)))
    for parts in (salt, F.pmod(salt, F.lit(math.isqrt(partitions(rows.sparkSession)))), F.lit(0)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", parts).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows
