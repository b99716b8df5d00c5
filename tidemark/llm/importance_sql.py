"""DuckDB SQL of target-distribution resampling; crc32 is worked out byte by byte from its generating polynomial."""

OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark
), words AS (
  SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT r, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, CAST(length(hex(encode(f))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features) x, crc
), counts AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts, totals
), sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CASE WHEN n > 0 THEN (total - ((total % n + n) % n)) // n ELSE 0 END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS noise
  FROM words LEFT JOIN sums USING (r) WHERE NOT target
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
