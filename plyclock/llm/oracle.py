"""The corpus queries that SQL can express, as plain SQL over the given tables."""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
phrases AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w)
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS s FROM phrases),
inner_parts AS (
  SELECT lang, unnest([array_to_string(s[1:k - 1], ' '), array_to_string(s[2:k], ' ')]) AS phrase, f
  FROM split WHERE k > 2),
left_over AS (
  SELECT * FROM split c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 100 * c.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, cut,
         CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM left_over c JOIN range(1, 5) u(cut) ON cut < c.k
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:cut], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang),
worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM worst
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

# The CRC-32 of a text, byte by byte, with the table of its 256 remainders made by its rule.
VARIANTS = r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) for i in range(8)]),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT run, n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM lowered),
hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) for i in range(length(x) // 2)]),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, remainders),
formed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
              ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM formed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) g(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other FROM shorter a JOIN shorter b
    ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest),
best AS (
  SELECT e.word, count(*) AS n_near, max(w.n) AS most FROM near e JOIN words w ON w.word = e.other GROUP BY e.word),
chosen AS (
  SELECT e.word, min(w.word) AS form, any_value(w.n) AS form_n
  FROM near e JOIN words w ON w.word = e.other JOIN best b ON b.word = e.word AND b.most = w.n
  JOIN words o ON o.word = e.word WHERE w.n >= 5 * o.n GROUP BY e.word),
chain AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN chosen f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT w.word, c.form, e.root, w.n, coalesce(b.n_near, 0) AS n_near, c.form_n
FROM words w JOIN ends e ON e.word = w.word
LEFT JOIN chosen c ON c.word = w.word LEFT JOIN best b ON b.word = w.word
"""

ORACLE = {"op12_pair_tiles": PHRASES, "op13_sorted_variants": VARIANTS}
