"""Drawing documents whose n-grams look like a target's, by importance weights over hashed buckets.

Words and pairs of words fall into buckets by crc32. A bucket's gain is the log ratio of
its share in the target and in the corpus; a document's weight is the mean gain of its
features; adding Gumbel noise from a hash of the key and taking the highest sums draws
without replacement in proportion to the weights. Everything is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import numbered
from tidemark.llm.storage import written

#: Fixed value: what separates words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS, _BUCKETS, _SIZE, _UID, _WEIGHT = "_tm_words", "_tm_buckets", "_tm_n_words", "_tm_uid", "_tm_weight"


def with_buckets(df: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """df without `text`, with _tm_n_words (int) and _tm_buckets: the bucket of every word and every pair of neighbouring words, repeats counted.

    Null texts have no words. The strings of pairs are not kept: a row holds its words
    and one number for each feature.
    """
    keep = [f"`{c}`" for c in df.columns if c != text]
    pattern = SEPARATORS.replace("\\", "\\\\")
    words = df.selectExpr(*keep, f"array_remove(split(translate(coalesce(cast(`{text}` AS string), ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '{pattern}'), '') AS {_WORDS}")
    bucket = f"cast(crc32({{}}) % {buckets} AS int)"
    pairs = f"transform(slice({_WORDS}, 2, greatest(size({_WORDS}) - 1, 0)), (b, i) -> {bucket.format(f'''concat({_WORDS}[i], ' ', b)''')})"
    return words.selectExpr(*keep, f"size({_WORDS}) AS {_SIZE}", f"concat(transform({_WORDS}, x -> {bucket.format('x')}), {pairs}) AS {_BUCKETS}")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode(_BUCKETS).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain (long) for every bucket: floor(1000 * ln of its smoothed share in target over that in docs). As many rows as buckets."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_counted(docs, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    double = lambda c: F.col(c).cast("double")
    ratio = ((double("t") + 1) * (double("all_s") + buckets)) / ((double("s") + 1) * (double("all_t") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20, buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without `text`, with n_features, weight, score, rank (long): the highest `percent` of the scores of documents with min_words words or more, ranked from 1; rank is null where a document is not drawn.

    weight is the floored mean gain (0 without features), score adds floored Gumbel noise
    from sha256 of `seed:key`. Ties go to the smaller key (null first, hashed as an empty
    one); rows of one key and score stand by their number of features. Null and empty
    texts have no features; an empty docs gives no rows, an empty target even shares.
    Columns with the names of the new ones are replaced.
    """
    docs = docs.drop("n_features", "weight", "score", "rank")
    # The buckets are written: one pass over the texts serves the counts and the sums.
    rows = written(with_buckets(docs.withColumn(_UID, F.monotonically_increasing_id()), text, buckets), "buckets")
    table = gains(rows, with_buckets(target.select(text), text, buckets), buckets)
    sums = rows.select(_UID, F.explode(_BUCKETS).alias("bucket")).join(F.broadcast(table), "bucket").groupBy(_UID).agg(F.sum("gain").alias(_WEIGHT))
    scored = rows.withColumn("n_features", F.size(_BUCKETS).cast("long")).drop(_BUCKETS).join(sums, _UID, "left")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    total = F.col(_WEIGHT)
    mean = F.when(F.col("n_features") > 0, F.expr(f"({_WEIGHT} - pmod({_WEIGHT}, n_features)) div n_features")).otherwise(0)
    scored = scored.withColumn(_WEIGHT, F.coalesce(total, F.lit(0))).withColumn("weight", mean.cast("long")).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = written(scored.drop(_WEIGHT), "scores")
    able = scored.where(F.col(_SIZE) >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col(key).asc(), F.col("n_features").asc(), F.col(_UID).asc()]
    ranked = numbered(able.select(_UID, "score", key, "n_features"), order, "rank").where(F.col("rank") <= drawn).select(_UID, F.col("rank").cast("long"))
    kept = [c for c in docs.columns if c != text]
    return scored.join(ranked, _UID, "left").select(*kept, "n_features", "weight", "score", "rank")
