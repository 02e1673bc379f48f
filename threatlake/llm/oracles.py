"""SQL twins of text queries, where SQL can express them."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)
),
places AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
),
hits AS (SELECT DISTINCT doc_id, n, k, item_id FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
owned AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owned USING (doc_id)""",
    "op9_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, i, line, list_filter(regexp_split_to_array({_LOWER.format("line")}, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
firsts AS (
  SELECT array_to_string(ws, ' ') AS full_line, any_value(ws) AS ws, min((doc_id, i)) AS place FROM lines WHERE len(ws) > 0 GROUP BY 1
),
cut AS (
  SELECT full_line, place, k, array_to_string(ws[1 : k - 1] || ws[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM firsts WHERE len(ws) >= 8)
),
best AS (SELECT rest, k, min(place) AS place FROM cut GROUP BY rest, k),
near AS (
  SELECT c.full_line FROM cut c JOIN best b ON b.rest = c.rest AND b.k = c.k AND b.place < c.place
  UNION
  SELECT CASE WHEN c.place < f.place THEN f.full_line ELSE c.full_line END FROM cut c JOIN firsts f ON f.full_line = c.rest AND len(f.ws) >= 8
),
judged AS (
  SELECT l.doc_id, l.i, l.line, len(l.ws) > 0 AND (l.doc_id, l.i) <> f.place AS later,
    len(l.ws) > 0 AND n.full_line IS NOT NULL AND (l.doc_id, l.i) = f.place AS near
  FROM lines l LEFT JOIN firsts f ON f.full_line = array_to_string(l.ws, ' ') LEFT JOIN near n ON n.full_line = f.full_line
),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(later, false) AND NOT near), '') AS text,
    count(*) FILTER (WHERE later) AS n_exact, count(*) FILTER (WHERE near) AS n_near
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, d.text) END AS text,
  coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near
FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op11_periodic_runs": r"""
WITH hashed AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws,
    xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM documents
),
placed AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM hashed),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws
  FROM placed
),
fives AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS five FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 6)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM fives x JOIN fives y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
best AS (
  SELECT * FROM runs r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1
),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS listing FROM runs GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS i FROM runs) GROUP BY doc_id),
words AS (SELECT doc_id, i, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(0, n)) AS i FROM d)),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM words w LEFT JOIN (SELECT DISTINCT doc_id, unnest(gone) AS i FROM gone) x USING (doc_id, i) WHERE x.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
  CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
),
spoken AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces) WHERE len(ws) > 0),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM spoken GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM spoken CROSS JOIN range(1, 6) t(m) WHERE len(ws) >= m)
  GROUP BY ALL HAVING count(*) >= 100
),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, x.f AS l, y.f AS r, c.k, CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[: c.k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT lang, array_to_string(ws[s : s + w - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - w + 2)) AS s FROM candidates CROSS JOIN range(2, 5) t(w) WHERE w < m)
),
free AS (SELECT l.* FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = l.lang AND i.phrase = l.phrase AND i.a >= l.a)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM numbered WHERE rank <= 2000""",
}
