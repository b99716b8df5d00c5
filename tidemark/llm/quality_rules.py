"""Quality rules: statistics of each text in Spark expressions, and a decision list learned from labelled ones.

Sequential covering (grow on two thirds of the labelled rows, prune on the rest) finds
conjunctions of thresholds under which texts are bad; the ordered list becomes one
CASE WHEN expression. Everything that touches the corpus is a built-in expression. The
driver fits the list on at most MAX_LABELLED labelled rows (the least by a hash of the
key, so the same at every run), which bounds what it collects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
#: The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: name and expression over the statistics (n_words is above 0 wherever a rule is asked).
FEATURES = {
    "symbols_per_100_words": "100.0D * n_symbols / n_words",
    "chars_per_word": "1.0D * word_chars / n_words",
    "dup_lines_per_100_words": "100.0D * n_dup_lines / n_words",
    "repeat_percent": "100.0D * n_repeat_words / n_words",
    "distinct_percent": "100.0D * n_distinct_words / n_words",
    "capitals_percent": "100.0D * n_capitals / word_chars",
    "shouts_per_100_words": "100.0D * n_shouts / n_words",
}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with BASE, n_distinct_words, n_capitals, n_shouts (long) and base_failed (boolean); null text counts as empty. Columns of docs with these names are replaced."""
    new = [*BASE, "n_distinct_words", "n_capitals", "n_shouts", "base_failed"]
    docs = docs.drop(*new)
    keep = [f"`{c}`" for c in docs.columns]
    t = "coalesce(cast(`" + text + "` AS string), '')"
    a = docs.selectExpr(*keep, rf"filter(split({t}, '{SPACE.replace(chr(92), chr(92) * 2)}'), x -> x <> '') AS _tm_words", rf"filter(split({t}, '\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]')) AS _tm_lines", f"{t} AS _tm_text")
    b = a.selectExpr(
        *keep,
        "cast(size(_tm_words) AS long) AS n_words",
        "cast(length(array_join(_tm_words, '')) AS long) AS word_chars",
        "cast(length(_tm_text) - length(translate(_tm_text, '#*$%&|<>', '')) AS long) AS n_symbols",
        "cast(size(_tm_lines) - size(array_distinct(_tm_lines)) AS long) AS n_dup_lines",
        "cast(size(array_distinct(_tm_words)) AS long) AS n_distinct_words",
        r"cast(regexp_count(_tm_text, '\\p{Lu}') AS long) AS n_capitals",
        "cast(length(_tm_text) - length(replace(_tm_text, '!', '')) AS long) AS n_shouts",
        "CASE WHEN size(_tm_words) >= 6 THEN transform(sequence(0, size(_tm_words) - 5), i -> xxhash64(_tm_words[i], _tm_words[i + 1], _tm_words[i + 2], _tm_words[i + 3], _tm_words[i + 4])) END AS _tm_grams",
    )
    # Only texts in which a window recurs are sorted; the rest have as many distinct windows as windows.
    c = b.withColumn("_tm_sorted", F.expr("CASE WHEN size(array_distinct(_tm_grams)) < size(_tm_grams) THEN array_sort(transform(_tm_grams, (h, i) -> named_struct('h', h, 'i', i))) END"))
    c = c.withColumn(
        "_tm_at",
        F.expr("array_sort(transform(filter(_tm_sorted, (x, k) -> (k > 0 AND _tm_sorted[greatest(k - 1, 0)].h = x.h) OR (k < size(_tm_sorted) - 1 AND _tm_sorted[least(k + 1, size(_tm_sorted) - 1)].h = x.h)), x -> x.i))"),
    )
    c = c.withColumn("n_repeat_words", F.expr("coalesce(aggregate(_tm_at, named_struct('n', 0L, 'last', -5), (s, p) -> named_struct('n', s.n + least(5, p - s.last), 'last', p), s -> s.n), 0L)"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return c.withColumn("base_failed", failed).select(*keep, *new)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict) -> bool:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction under which a text is rejected; texts that meet none are kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self) -> Column:
        """True for texts to keep, over the columns of with_statistics."""
        if not self.rules:
            return F.lit(True)
        cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in self.rules)
        return F.expr(f"CASE {cases} ELSE true END")

    def __str__(self) -> str:
        return "".join(f"reject if {' and '.join(map(str, r))}\n" for r in self.rules) + "else keep"


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, cuts: int = 32, min_precision: float = 0.8) -> DecisionList:
    """Sequential covering over rows with the FEATURES, `bad` (boolean) and `prune` (boolean: held out for pruning).

    A rule grows by the condition of the largest FOIL gain until it covers no good row
    or nothing gains; it is pruned to the prefix that does best on the held-out rows and
    joins the list while at least min_precision of the rows it covers there, and in all, are
    bad and it covers two held-out bad rows or more. Rows it covers are then taken away.
    """
    left, rules = list(rows), []
    while len(rules) < max_rules:
        grow, hold = [x for x in left if not x["prune"]], [x for x in left if x["prune"]]
        rule: list[Condition] = []
        covered = grow
        while len(rule) < max_conditions and any(x["bad"] for x in covered) and not all(x["bad"] for x in covered):
            best = _best(covered, cuts)
            if best is None:
                break
            rule.append(best)
            covered = [x for x in covered if best.holds(x)]
        if not rule:
            break
        pruned = max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (_worth(r, hold), -len(r)))
        p, n = _counts(pruned, hold)
        bad, good = _counts(pruned, left)
        if p < 2 or p < min_precision * (p + n) or bad < min_precision * (bad + good):
            break
        rules.append(tuple(pruned))
        left = [x for x in left if not all(c.holds(x) for c in pruned)]
    return DecisionList(tuple(rules))


def _counts(rule: list[Condition], rows: list[dict]) -> tuple[int, int]:
    hit = [x["bad"] for x in rows if all(c.holds(x) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _worth(rule: list[Condition], rows: list[dict]) -> float:
    p, n = _counts(rule, rows)
    return (p - n) / (p + n) if p + n else -1.0


def _best(rows: list[dict], cuts: int) -> Condition | None:
    """The condition of the largest FOIL gain on rows; thresholds lie halfway between values, at `cuts` quantiles of the bad rows' and of all rows' values."""
    bad, total = sum(x["bad"] for x in rows), len(rows)
    base = math.log2(bad / total)
    best, most = None, 1e-9
    for f in FEATURES:
        ordered = sorted((x[f], x["bad"]) for x in rows)
        values = [v for v, _ in ordered]
        before = [0]
        for _, b in ordered:
            before.append(before[-1] + b)
        edges = [i for i in range(1, total) if values[i] > values[i - 1]]
        if len(edges) > 2 * cuts:
            marks = {bad * k // cuts for k in range(1, cuts)}
            some, seen = [], set()
            for j, i in enumerate(edges):
                step = (before[i] * cuts // max(bad, 1), i * cuts // total)
                if step not in seen or before[i] in marks or j in (0, len(edges) - 1):
                    seen.add(step)
                    some.append(i)
            edges = some
        for i in edges:
            for above, p, n in ((True, bad - before[i], total - i), (False, before[i], i)):
                gain = p * (math.log2(p / n) - base) if p else 0.0
                if gain > most:
                    best, most = Condition(f, above, (values[i] + values[i - 1]) / 2), gain
    return best


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn from the documents that labels call good (quality 1) or bad (0), at most max_labelled of them; those that fail the base rule teach nothing.

    Null labels and ids, labels of unknown documents and ids with labels of both kinds
    teach nothing; of documents with one id the one with the least text hash does. Without
    any bad document the list is empty and keeps all.
    """
    ids = labels.select(labels[doc_id].alias("_tm_id"), labels[quality].cast("int").alias("_tm_good")).where("_tm_id IS NOT NULL AND _tm_good IS NOT NULL")
    some = ids.groupBy("_tm_id").agg(F.min("_tm_good").alias("_tm_good"), F.max("_tm_good").alias("_tm_most")).where("_tm_good = _tm_most").drop("_tm_most").orderBy(F.xxhash64("_tm_id"), "_tm_id").limit(max_labelled)
    labelled = docs.select(docs[doc_id].alias("_tm_id"), docs[text].alias("_tm_raw")).join(F.broadcast(some), "_tm_id")
    labelled = labelled.groupBy("_tm_id", "_tm_good").agg(F.min_by("_tm_raw", F.xxhash64("_tm_raw")).alias("_tm_raw"))
    # Rows that fail the base rule are left out after collecting: a filter here would be pushed below the statistics and compute them again.
    rows = with_statistics(labelled, "_tm_raw").selectExpr(*(f"CASE WHEN word_chars > 0 THEN {e} END AS {f}" for f, e in FEATURES.items()), "_tm_good = 0 AS bad", "pmod(xxhash64(_tm_id, 7), 3) = 0 AS prune", "base_failed")
    return learn(sorted((r.asDict() for r in rows.collect() if not r["base_failed"]), key=lambda r: sorted(r.items())))


def apply_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with the statistics, base_failed and kept: false if base_failed, else the list's verdict. No row is added or dropped; a column named kept is replaced."""
    return with_statistics(docs.drop("kept"), text).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rules.verdict()))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of docs that apply_rules keeps, with their own columns."""
    judged = apply_rules(docs, rules, text).select(*(F.col(f"`{c}`") for c in docs.columns), F.col("kept").alias("_tm_kept"), F.monotonically_increasing_id().alias("_tm_row"))
    # The row number is no deterministic expression, so the filter stays above the statistics instead of being pushed into them, where they would be computed twice; the rows are the same either way.
    return judged.where("_tm_kept AND _tm_row >= 0").drop("_tm_kept", "_tm_row")
