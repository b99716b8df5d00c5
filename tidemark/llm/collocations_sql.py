"""DuckDB SQL of phrase collocation mining: every phrase counted, without hashing."""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL
), words AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30
), cut AS (
  SELECT c.lang, c.phrase, c.a, i, x.n AS l, y.n AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.n + y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2) x) y
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = b.lang AND s.phrase = b.phrase AND CAST(s.a AS HUGEINT) * 100 >= CAST(b.a AS HUGEINT) * 80)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""
